"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Only confirmed toxic documents are used as such; everything else is unlabelled text, in which the share ``prior`` is
toxic. With loss l, the risk of a classifier f is estimated as ``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])``;
where the second part of a batch is negative, its gradient is turned, so that the fit can't profit from the
unlabelled toxic documents. Features are letter n-grams (``GRAM`` bytes of the lower-cased text, all else white space) that a text
has once, or at least so often as a level of ``LEVELS`` says (a word stem that any text may have once can tell by its
repetition); those that are clearly more frequent in confirmed documents than in unlabelled ones; f is linear in which a text has.

Training is bounded: ``POSITIVE`` toxic and ``UNLABELLED`` other rows, of longer texts ``training.MAX_BYTES`` bytes. All n-grams
that pass the tests are features. Scoring reads whole texts.

Defined cases: null and empty texts have no n-gram and get the score of the intercept; rows with a null id are never
learned from and count as not held out; without confirmed rows every score is 0; each row is scored by its text alone, so
repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import free_name, pieces, shared_state, table
from rackpulse.llm.training import held_out, sample_ids, sample_texts

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
GRAM, BITS = 7, 22
#: Numbers of occurrences from which an n-gram counts as a feature of its own.
LEVELS = (1, 2, 3, 5)
POSITIVE, UNLABELLED, ROUNDS, BATCH = 2000, 6000, 15, 256
#: An n-gram is a feature if so many confirmed documents have it; if its share of them is above its share of the unlabelled ones
#: by so many standard deviations; and if unlabelled documents do not have it clearly more often (``SLACK`` standard deviations of
#: a Poisson count) than toxic ones among them account for, twice over. The last is a test of the count that was seen, so a sample
#: with few toxic rows or none keeps n-grams whatever the prior.
LEAST_DOCS, LEAST_RATIO, LEAST_Z, SLACK = 8, 0.5, 3.0, 2.0
_PIECE = 1 << 21
_M = np.uint64(0x9E3779B97F4A7C15)


def letters_only(data: np.ndarray) -> np.ndarray:
    """Lower-case letters (bytes from 0x80 count as letters), white space for all else."""
    low = np.full(256, 32, np.uint8)
    low[97:123] = np.arange(97, 123)
    low[65:91] = np.arange(97, 123)
    low[128:] = np.arange(128, 256)
    out = low[data]
    # À to Þ in UTF-8 are 0xC3 and 0x80 to 0x9E; their lower-case letters stand 0x20 after them
    out[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0
                        ).astype(np.uint8)
    return out


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram at each place, text of each place); n-grams of one word, its two ends being white space."""
    data = letters_only(np.frombuffer(b"".join(b" " + t + b" " * GRAM for t in texts), np.uint8))
    code = np.zeros(len(data) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | data[i:len(data) - GRAM + 1 + i]
    owner = np.repeat(np.arange(len(texts)), [len(t) + GRAM + 1 for t in texts])[:len(code)]
    inner = np.ones(len(code), bool)
    for i in range(1, GRAM - 1):
        inner &= data[i:len(code) + i] != 32
    return ((code * _M) >> np.uint64(64 - BITS)).astype(np.int64)[inner], owner[inner]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _PIECE:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class ToxicModel:
    def __init__(self, slot: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.slot, self.weights, self.intercept = slot, weights, intercept  # slot: feature of each code, -1 if none

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        for start, part in _pieces(texts):
            feature, owner = features(part, self.slot)
            np.add.at(z, start + owner, self.weights[feature])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def level_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code of an n-gram and a level that its number of occurrences reaches, text), each once, in the order of texts."""
    code, owner = gram_codes(texts)
    key, times = np.unique(owner.astype(np.int64) << BITS | code, return_counts=True)
    codes = [(key[times >= least] ^ (i * 0x2A5F37 & (1 << BITS) - 1)) for i, least in enumerate(LEVELS)]
    key = np.unique(np.concatenate(codes))
    return key & (1 << BITS) - 1, key >> BITS


def features(texts: list[bytes], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text), each once, in the order of texts."""
    code, owner = level_codes(texts)
    feature = slot[code]
    has = feature >= 0
    return feature[has], owner[has]


def _document_counts(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(1 << BITS, np.int32)
    for _, part in _pieces(texts):
        found, times = np.unique(level_codes(part)[0], return_counts=True)
        out[found] += times
    return out


class _Rows:
    """The features of many texts, row after row."""

    def __init__(self, texts: list[bytes], slot: np.ndarray) -> None:
        parts = [(f, start + o) for start, part in _pieces(texts) for f, o in [features(part, slot)]]
        self.feature = np.concatenate([f for f, _ in parts]) if parts else np.zeros(0, np.int64)
        owner = np.concatenate([o for _, o in parts]) if parts else np.zeros(0, np.int64)
        self.at = np.searchsorted(owner, np.arange(len(texts) + 1))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, place in ``rows``)"""
        size = self.at[rows + 1] - self.at[rows]
        begin = np.cumsum(size) - size
        return self.feature[np.repeat(self.at[rows] - begin, size) + np.arange(size.sum())], np.repeat(np.arange(len(rows)), size)

    def __len__(self) -> int:
        return len(self.at) - 1


def _above(df_p: np.ndarray, n_p: int, df_u: np.ndarray, n_u: int) -> np.ndarray:
    """Standard deviations by which the share of df_p in n_p is above that of df_u in n_u (pooled, as in chi-square)."""
    n_p, n_u = max(1, n_p), max(1, n_u)
    pooled = (df_p + df_u) / (n_p + n_u)
    return (df_p / n_p - df_u / n_u) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n_u))


def _accounted(share: np.ndarray, prior: float, n_u: int) -> np.ndarray:
    """The largest count among ``n_u`` unlabelled documents that fits an n-gram of toxic ones (square roots of Poisson counts have
    a standard deviation of 1/2)."""
    return (np.sqrt(share * prior * n_u / LEAST_RATIO) + SLACK / 2) ** 2


def risk_gradient(zu: np.ndarray, zp: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the non-negative risk by the outputs for unlabelled and positive rows, with the loss l(z) = sigmoid(-z); where
    the risk of negatives is below 0, that of its opposite alone."""
    su, sp = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zu, zp))
    gu, gp = su * (1 - su) / len(zu), -prior * sp * (1 - sp) / len(zp)  # of the risk of negatives
    if su.mean() - prior * sp.mean() < 0:
        return -gu, -gp
    return gu, 2 * gp


def fit_pu(positive: list[bytes], unlabelled: list[bytes], prior: float, seed: int = 5) -> ToxicModel:
    df_p, df_u = _document_counts(positive), _document_counts(unlabelled)
    chosen = np.flatnonzero((df_p >= min(LEAST_DOCS, len(positive))) & (_above(df_p, len(positive), df_u, len(unlabelled)) >= LEAST_Z)
                            & (df_u <= _accounted(df_p / max(1, len(positive)), prior, len(unlabelled))))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    p_rows, u_rows = _Rows(positive, slot), _Rows(unlabelled, slot)
    rng, w, b = np.random.default_rng(seed), np.zeros(len(chosen)), -1.0
    m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(u_rows))
        for a in range(0, len(order), BATCH):
            picked = order[a:a + BATCH]
            (fu, ou), (fp, op) = u_rows.take(picked), p_rows.take(rng.integers(0, len(p_rows), BATCH // 2))
            zu, zp = (np.bincount(o, w[f], n) + b for f, o, n in ((fu, ou, len(picked)), (fp, op, BATCH // 2)))
            gu, gp = risk_gradient(zu, zp, prior)
            grad = np.bincount(fu, gu[ou], len(w)) + np.bincount(fp, gp[op], len(w)) + 1e-4 * prior * w
            gb = gu.sum() + gp.sum()
            step += 1
            m, v = m + 0.1 * (grad - m), v + 0.01 * (grad * grad - v)
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
            fix, fix2 = 1 - 0.9 ** step, 1 - 0.99 ** step
            w = w - 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-5 * prior)
            b = float(b - 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-5 * prior))
    return ToxicModel(slot, w.astype(np.float64), b)


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> ToxicModel | None:
    """A model fitted outside the held-out fold; the prior is the share of toxic rows among the labelled ones there."""
    rows = labels.where(F.col("toxic").isNotNull() & ~held_out(FOLDS, HELD_OUT)).groupBy("doc_id").agg(
        F.max("toxic").alias("y"))
    own = docs.select("doc_id", "text")
    prior = rows.agg(F.avg("y")).first()[0]
    toxic = sample_texts(own, sample_ids(rows.where("y = 1"), positive))
    if not toxic:
        return None
    other = sample_texts(own, sample_ids(own.where(~held_out(FOLDS, HELD_OUT)), unlabelled))
    return fit_pu(toxic, other, prior)


def with_toxicity(docs: DataFrame, model: ToxicModel | None, name: str = "score") -> DataFrame:
    """The documents, all columns, with the toxicity in column ``name``."""
    columns, own = [c for c in docs.columns if c.lower() != name.lower()], free_name(docs, "text_bytes")
    schema = docs.select(*columns).schema.add(name, "double")
    wide = docs.select(*columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(own))
    shared = shared_state(docs.sparkSession, model)  # 16 MB of slots, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in pieces(batches):
            texts = batch.column(own).to_pylist()
            found = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)],
                                             names=[*columns, name])

    return wide.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
