"""Quality classifier: a convolutional network over bytes, in numpy.

Learned filters look at every window of ``WIDTH`` bytes of a text. The text is covered by overlapping chunks (half a chunk
apart); in each, a filter's largest answer is kept. A chunk's answers go through a hidden layer, and the mean and the
maximum over all chunks are combined into one probability. Scoring reads whole texts of any length in pieces.

Training is bounded: at most ``SAMPLE`` labelled rows per label (of longer texts ``training.MAX_BYTES`` bytes), at most
``CHUNKS`` chunks of each per round, chosen anew each time; seeds are fixed, so reruns agree. Rows of the held-out fold are
never learned from.

Defined cases: null and empty texts are scored by the network as one chunk without answers; a text shorter than a window
is padded; rows with a null id are never learned from and count as not held out; a document with several labels
counts as the rounded mean; without labelled rows of both kinds every score is the prior, 0.5 if there is none; each
row is scored by its text alone, so repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import free_name, pieces, table
from rackpulse.llm.training import held_out, sample_ids, sample_texts

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bytes of a filter's window, filters, hidden units, half a chunk in bytes.
WIDTH, FILTERS, HIDDEN, HALF = 6, 16, 12, 128
SAMPLE, CHUNKS, ROUNDS, BATCH = 1500, 8, 10, 64
_PIECE = 1 << 19


class ByteNet:
    """Parameters: ``filters`` (WIDTH, 256, FILTERS), ``bias``, hidden layer, output layer over [mean, max] of chunks."""

    def __init__(self, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
        self.pairs: list[np.ndarray] | None = None

    # ---- scoring

    def scores(self, texts: list[bytes]) -> np.ndarray:
        pooled, size = [], 0
        held: list[bytes] = []
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= _PIECE:
                pooled.append(self._documents(held))
                held, size = [], 0
        pooled.append(self._documents(held))
        return self._probability(np.concatenate(pooled))

    def _documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum over the chunks' hidden units, per text."""
        if not texts:
            return np.zeros((0, 2 * HIDDEN), np.float32)
        halves = [-(-max(len(t), 1) // HALF) for t in texts]
        best = self._half_answers(b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves, strict=True)),
                                  np.cumsum(halves) * HALF)
        # a chunk is two halves; a text of one half is one chunk
        at = np.cumsum(halves) - halves
        chunk = np.maximum(best, np.concatenate([best[1:], best[-1:]]))
        last = at + np.array(halves) - 1
        alone = np.array(halves) == 1
        chunk[last[alone]] = best[last[alone]]
        keep = np.ones(len(best), bool)
        keep[last[~alone]] = False
        hidden = np.maximum(chunk[keep] @ self.p["hidden"] + self.p["hidden_bias"], 0)
        count = np.maximum(np.array(halves) - 1, 1)
        begin = np.cumsum(count) - count
        return np.hstack([np.add.reduceat(hidden, begin) / count[:, None], np.maximum.reduceat(hidden, begin)])

    def _half_answers(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """The filters' largest answers (0 at least) among the windows that begin in each half. Windows that reach over the
        end of a padded text, into the next one, don't count."""
        over = (ends[:, None] - np.arange(WIDTH - 1, 0, -1)).ravel()
        if self.pairs is None:  # two neighbouring bytes at a time
            f = self.p["filters"]
            self.pairs = [(f[i][:, None, :] + f[i + 1][None, :, :]).reshape(1 << 16, FILTERS) for i in range(0, WIDTH, 2)]
        code = np.frombuffer(data + b"\0" * WIDTH, np.uint8).astype(np.uint16)
        code = (code[:-1] << 8) | code[1:]
        out = np.empty((len(data) // HALF, FILTERS), np.float32)
        step = _PIECE // HALF * HALF
        for a in range(0, len(data), step):
            n = min(step, len(data) - a)
            answer = np.take(self.pairs[0], code[a:a + n], axis=0)
            for i in range(1, WIDTH // 2):
                answer += np.take(self.pairs[i], code[a + 2 * i:a + 2 * i + n], axis=0)
            answer[over[np.searchsorted(over, a):np.searchsorted(over, a + n)] - a] = -np.inf
            out[a // HALF:(a + n) // HALF] = answer.reshape(-1, HALF, FILTERS).max(1)
        return np.maximum(out + self.p["bias"], 0)

    def _probability(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    # ---- training

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 4) -> ByteNet:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, steps = 0, ROUNDS * -(-len(texts) // BATCH)
        for _ in range(ROUNDS):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                grads = self._gradients([texts[i] for i in pick], labels[pick], rng)
                step += 1
                rate = 0.01 * (1 - step / (steps + 1))
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        self.pairs = None
        return self

    def _gradients(self, texts: list[bytes], y: np.ndarray, rng) -> dict[str, np.ndarray]:
        p, size = self.p, 2 * HALF
        rows, owner = [], []
        for i, t in enumerate(texts):
            starts = np.arange(0, max(len(t) - HALF, 1), HALF)
            if len(starts) > CHUNKS:
                starts = rng.choice(starts, CHUNKS, replace=False)
            rows += [t[s:s + size + WIDTH].ljust(size + WIDTH, b"\0") for s in starts.tolist()]
            owner += [i] * len(starts)
        code = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), size + WIDTH)
        owner = np.array(owner)
        answer = sum(p["filters"][w][code[:, w:w + size]] for w in range(WIDTH)) + p["bias"]
        place = answer.argmax(1)
        top = np.take_along_axis(answer, place[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        pre = pooled @ p["hidden"] + p["hidden_bias"]
        hidden = np.maximum(pre, 0)
        count = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(count) - count
        peak = np.maximum.reduceat(hidden, begin)
        doc = np.hstack([np.add.reduceat(hidden, begin) / count[:, None], peak])
        err = ((self._probability(doc) - y) / len(texts)).astype(np.float32)
        g_doc = err[:, None] * p["out"]
        g_hidden = (g_doc[:, :HIDDEN] / count[:, None])[owner]
        g_hidden += g_doc[owner, HIDDEN:] * (hidden == peak[owner])
        g_pre = g_hidden * (pre > 0)
        g_top = (g_pre @ p["hidden"].T) * (top > 0)
        g_filters = np.zeros_like(p["filters"])
        for w in range(WIDTH):
            seen = np.take_along_axis(code, place + w, 1)
            np.add.at(g_filters[w], (seen, np.arange(FILTERS)[None, :]), g_top)
        out = {"filters": g_filters, "bias": g_top.sum(0), "hidden": pooled.T @ g_pre, "hidden_bias": g_pre.sum(0),
               "out": doc.T @ err, "out_bias": err.sum(keepdims=True)}
        return {k: g + 1e-5 * p[k] for k, g in out.items()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNet | float:
    """A network fitted to the labelled rows outside the held-out fold, or their mean label if it can't be."""
    rows = (labels.where(F.col("quality").isNotNull() & ~held_out(FOLDS, HELD_OUT)).groupBy("doc_id")
            .agg(F.round(F.avg("quality")).cast("int").alias("y")))
    own = docs.select("doc_id", "text")
    texts = [sample_texts(own, sample_ids(rows.where(F.col("y") == y), sample)) for y in (0, 1)]
    if not all(texts):
        return float(bool(texts[1])) if any(texts) else 0.5
    y = np.repeat([0.0, 1.0], [len(t) for t in texts])
    return ByteNet().fit(texts[0] + texts[1], y)


def with_scores(docs: DataFrame, net: ByteNet | float, name: str = "score") -> DataFrame:
    """The documents, all columns, with the probability of label 1 in column ``name``."""
    columns, own = [c for c in docs.columns if c.lower() != name.lower()], free_name(docs, "text_bytes")
    schema = docs.select(*columns).schema.add(name, "double")
    wide = docs.select(*columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(own).to_pylist()
            found = net.scores(texts) if isinstance(net, ByteNet) else np.full(len(texts), float(net))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)],
                                             names=[*columns, name])

    return wide.mapInArrow(run, schema)


def op4_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
