"""Language identification by cross-parsing entropy.

A suffix automaton holds all substrings of labelled text of each language. A text is parsed with each automaton into the
longest matches there are, one after the other; a language in which few phrases suffice is like the text. Phrases are
normalised to bits per letter, ``phrases * log2(training size) / length``; the language with the fewest wins, ties go to
the smaller name. Text is taken as lower-case letters, all between them as one space.

Texts are cut into segments of ``SEGMENT`` letters that are parsed side by side by numpy (a segment begins a new phrase,
for every language alike), so a text of any length is read whole and in bounded memory.

Training is bounded: rows (of texts over ``training.MAX_BYTES`` characters a window), in the order of their ids' digests, up to
``BUDGET`` letters over all languages. Rows of the held-out fold are never learned from.

Defined cases: null texts and texts without letters are ``und`` with score 0; without training rows all texts are; letters
that no language's sample has are phrases of their own; rows with a null id are never learned from and count as not held out; each row is scored by its text alone, so repeated rows
agree; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import free_name, pieces, shared_state, store, table, worker_cache
from rackpulse.llm.training import MAX_BYTES, held_out, remainder, window_start

FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
#: Letters of training text over all languages, rows looked at per language, letters of a segment; and the number of frequent
#: letters whose transitions lie in a table (those of the rarer ones are searched for: there is no bound on the alphabet).
BUDGET, ROWS, SYMBOLS, SEGMENT = 160_000, 80, 250, 256
#: Texts of so many letters whose language takes more bits per letter than this are in none of the learned languages: held-out
#: documents of sf0.1 take 5.9 at most (99.9 % of longer ones below 4.6), other languages and random letters 8 to 15.
LEAST_LETTERS, MOST_BITS = 50, 7.0
_CHUNK = 1 << 22


def plain(text: str) -> str:
    """Lower-case letters with single spaces between words."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``text``; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, last = last, now
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p < 0:
            continue
        q = step[p][c]
        if length[q] == length[p] + 1:
            link[now] = q
            continue
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = link[now] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
    return step


class LanguageModel:
    """Automata of all languages as arrays: (state, symbol, next state); state 0 is nowhere, 1 the start."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        seen = Counter("".join(samples.values()))
        ranked = sorted((c for c in seen if c != " "), key=lambda c: (-seen[c], c))
        self.symbol = {" ": 0} | {c: 1 + i for i, c in enumerate(ranked)}
        self.unknown = 1 + len(ranked)  # letters that no sample has
        self.dense = 1 + min(len(ranked), SYMBOLS)
        self.edges, self.states, self.bits = [], [], []
        for name in self.names:
            text = samples[name]
            steps = suffix_automaton(text)
            self.edges.append(np.array([(s + 1, self.symbol[c], t + 1) for s, own in enumerate(steps) for c, t in own.items()],
                                       np.int32).reshape(-1, 3))
            self.states.append(len(steps) + 1)
            self.bits.append(float(np.log2(max(2, len(text)))))
        self.key = hashlib.sha256(pickle.dumps((self.names, self.symbol, self.edges))).hexdigest()


class Parser:
    def __init__(self, model: LanguageModel) -> None:
        self.model, self.tables, self.rare = model, [], []
        for edges, states in zip(model.edges, model.states, strict=True):
            often = edges[:, 1] < model.dense
            t = np.zeros(states * model.dense, np.int32)
            t[edges[often, 0] * model.dense + edges[often, 1]] = edges[often, 2]
            begin = np.zeros(model.unknown + 1, np.int32)
            begin[edges[edges[:, 0] == 1, 1]] = edges[edges[:, 0] == 1, 2]
            self.tables.append((t, begin))
            key = edges[~often, 0].astype(np.int64) * (model.unknown + 1) + edges[~often, 1]
            order = np.argsort(key)
            self.rare.append((np.append(key[order], np.iinfo(np.int64).max), np.append(edges[~often, 2][order], 0)))
        self.code = np.zeros(sys.maxunicode + 1, np.int32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                self.code[c] = model.symbol.get(low[0], model.unknown)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, and how many each has; nothing for a text without letters."""
        raw = self.code[np.frombuffer("".join(f" {t}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        keep = raw > 0
        keep[:-1] |= raw[1:] > 0  # of white space the last before a word; the text's own first goes below
        keep[begin] = False
        # white space before a text's first word
        word = np.flatnonzero(raw > 0)
        at = np.searchsorted(word, begin)
        first = word[at[at < len(word)]]
        keep[first[raw[first - 1] == 0] - 1] = False
        count = np.add.reduceat(keep.astype(np.int64), begin)
        return raw[keep], count

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, letters per text)"""
        data, count = self.symbols(texts)
        parts = -(-count // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(count) - count, parts) + number * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(count, parts) - number * SEGMENT)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        lanes = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), "right")  # segments that long
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        dense = np.int32(self.model.dense)
        columns = [data[start[:n] + t] for t, n in enumerate(lanes.tolist()) if n]
        rare = [np.flatnonzero(c >= dense) for c in columns]
        for k, (steps, begin) in enumerate(self.tables):
            state, found = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
            for column, seldom in zip(columns, rare, strict=True):
                n = len(column)
                if len(seldom):
                    to = steps[state[:n] * dense + np.minimum(column, dense - 1)]
                    to[seldom] = self._seldom(k, state[seldom], column[seldom])
                else:
                    to = steps[state[:n] * dense + column]
                new = to == 0
                found[:n] += new
                state[:n] = np.where(new, begin[column], to)
            out[:, k] = np.bincount(owner, found, len(texts)).astype(np.int64)
        return out, count

    def _seldom(self, k: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        keys, to = self.rare[k]
        key = state.astype(np.int64) * (self.model.unknown + 1) + symbol
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, to[at], 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.measure(texts)[:2]

    def measure(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text the language, its score, and the bits per letter it takes there (nan below ``LEAST_LETTERS`` letters)."""
        names, scores, bits, held, size = [], [], [], [], 0
        for t in [*texts, None]:
            if t is None or size + len(t) > _CHUNK and held:
                if held:
                    n, s, b = self._measure(held)
                    names += n
                    scores.append(s)
                    bits.append(b)
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)
        return names, *(np.concatenate(x) if x else np.zeros(0) for x in (scores, bits))

    def _measure(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found, count = self.phrases(texts)
        bits = found * np.array(self.model.bits) / np.maximum(count, 1)[:, None]
        best = bits.argmin(1)
        least = bits.min(1)
        if bits.shape[1] > 1:
            second = np.partition(bits, 1, axis=1)[:, 1]
            score = second / np.maximum(least + second, 1e-12)
        else:
            score = np.ones(len(texts))
        some = count > 0
        return ([self.model.names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)],
                np.where(some, score, 0.0), np.where(count >= LEAST_LETTERS, least, np.nan))


def train(docs: DataFrame, budget: int = BUDGET, rows: int = ROWS, max_bytes: int = MAX_BYTES) -> LanguageModel | None:
    """A model of the languages of the rows outside the held-out fold."""
    own = docs.select("doc_id", "lang", "text")
    usable = own.where(F.col("lang").isNotNull() & (remainder(FOLDS) != HELD_OUT) & (F.octet_length("text") > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    picked = usable.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    picked = store(picked.drop("place"), "language-sample")
    found = own.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select(
        "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.substring(
            "text", window_start(F.length("text"), max_bytes) + 1, F.lit(max_bytes)).alias("text")).toArrow().to_pylist()
    by_name: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["text"] or "")):
        by_name.setdefault(r["lang"], []).append(plain(r["text"] or ""))
    samples = {}
    for name, texts in by_name.items():
        text, share = "", max(1, budget // len(by_name))
        for t in texts:
            t = t if text else t[:share]
            if text and len(text) + len(t) > share:
                continue
            text = f"{text} {t}" if text else t
        if text.strip():
            samples[name] = text
    return LanguageModel(samples) if samples else None


def with_language(docs: DataFrame, model: LanguageModel | None, name: str = "lang_pred", score: str = "score",
                  bits: str | None = None) -> DataFrame:
    """The documents, all columns, with predicted language and score; and in column ``bits``, if named, the bits per letter that
    the text takes in that language (null below ``LEAST_LETTERS`` letters)."""
    new = [name, score, *([bits] if bits else [])]
    columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    whole = free_name(docs, "whole_text")
    schema = docs.select(*columns).schema.add(name, "string")
    for n in new[1:]:
        schema = schema.add(n, "double")
    wide = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias(whole))
    shared = shared_state(docs.sparkSession, model)  # bounded by the training budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        parser = worker_cache(f"language:{own.key}", lambda: Parser(own)) if own else None
        for batch in pieces(batches):
            texts = batch.column(whole).to_pylist()
            n = len(texts)
            names, scores, least = parser.measure(texts) if parser else ([UNKNOWN] * n, np.zeros(n), np.full(n, np.nan))
            values = [pa.array(names, pa.string()), pa.array(scores), pa.array(least, from_pandas=True, type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *values[:len(new)]], names=[*columns, *new])
    return wide.mapInArrow(run, schema)


def in_a_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents, all columns, that have a letter and don't show by their parsing that they are in none of the languages."""
    name, score, bits = (free_name(docs, n) for n in ("predicted_language", "language_score", "language_bits"))
    found = with_language(docs, model, name, score, bits)
    return found.where((F.col(name) != UNKNOWN) & (F.col(bits).isNull() | (F.col(bits) <= MOST_BITS))).drop(name, score, bits)


def op2_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_language(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
