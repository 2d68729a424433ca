"""Repeated passages, by a hash-compared suffix sort around anchors.

A byte is repeated if a string of 200 bytes that covers it also starts anywhere else, in the same text or another.

1. Anchors: a window of 200 bytes has as its anchor the 64 bytes in it whose hash is least (the first of equal ones), so equal
   windows have equal anchors at equal distances. Neighbouring windows of one anchor form a segment of at most 336 bytes.
2. Segments meet by their anchor's hash. Anchors that occur once are done. Equal segments (anchor hash and an
   independent 64-bit digest of the bytes) are repeated as a whole; only one of them goes on.
3. What is left are anchors with different segments. Their bytes are fetched, and each anchor's segments are suffix-sorted: a
   mergesort of the suffixes that start at the anchors, where two suffixes are compared by the length they have in common,
   found by binary search over polynomial prefix hashes. The reversed texts before the anchors are sorted likewise.
   Neighbours in both orders are then compared byte by byte; if a hash was wrong, the sort is done again with other hashes.
4. Two windows at distance d before their anchors are equal if d bytes before and 200 - d behind the anchors agree: stretches
   of the two orders between neighbours that share less. So each window's class is a pair of stretch numbers.
5. An anchor with more than ``BLOCK`` different segments isn't sorted in one task: its windows are compared by
   their 128-bit digests, counted in the cluster.

Defined cases: null and empty texts, and those of fewer than 200 bytes, have nothing to remove; a text that several rows have is
repeated as a whole; rows that repeat an id are texts of their own; an empty table gives an empty result; very long texts
are anchored in pieces that overlap by a window; columns other than the id and text are ignored (and kept by
``without_repeats``). Cuts are made between bytes: what is kept need not be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackpulse.llm.common import free_name, pieces, store, table

SPAN, GRAM = 200, 64
#: Most different segments of an anchor that are sorted in one task.
BLOCK = 4096
PIECE = 1 << 20
_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_PLACES = _U((1 << 22) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _M1
    h = (h ^ (h >> _U(29))) * _M2
    return h ^ (h >> _U(32))


class PrefixHashes:
    """Polynomial hashes (modulo 2^64) of all substrings, from sums over the prefixes."""

    def __init__(self, seed: int = 12) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.letters = rng.integers(1, 1 << 63, 256).astype(_U)
        self.powers = self.back = np.ones(1, _U)

    def over(self, data: np.ndarray) -> np.ndarray:
        while len(self.powers) <= len(data):
            n = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * _U(pow(self.base, n, 1 << 64))])
            self.back = np.concatenate([self.back, self.back * _U(pow(self.base, -n, 1 << 64))])
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.letters[data] * self.powers[:len(data)], out=sums[1:])
        return sums


# ---- anchors

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, _U)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    down = np.minimum.accumulate(rows, axis=1).ravel()
    up = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1:width - 1 + n])


def segments(texts: list[bytes], hashes: PrefixHashes, span: int = SPAN, gram: int = GRAM, piece: int = PIECE
             ) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor hash, digest, lo, hi, at) arrays: windows that start from lo to hi have their anchor at ``at``."""
    parts, size = [], 0
    cut = [(i, o, t[o:o + piece + span - 1]) for i, t in enumerate(texts) if len(t) >= span
           for o in range(0, len(t) - span + 1, piece)]
    for j, part in enumerate(cut):
        parts.append(part)
        size += len(part[2])
        if size >= piece or j == len(cut) - 1:
            with np.errstate(over="ignore"):
                yield _segments(parts, hashes, span, gram)
            parts, size = [], 0


def _segments(parts, hashes, span, gram):
    blob = b"".join(p for _, _, p in parts)
    data = np.frombuffer(blob, np.uint8)
    sums = hashes.over(data)
    grams = _mix((sums[gram:] - sums[:-gram]) * hashes.back[:len(data) - gram + 1])
    places = np.arange(len(grams), dtype=_U)
    anchor = (_least((grams & ~_PLACES) | places, span - gram + 1) & _PLACES).astype(np.int64)
    length = np.array([len(p) for _, _, p in parts])
    begin = np.cumsum(length) - length
    windows = length - span + 1
    start = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(parts)), windows)
    at = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at, owner = start[first], start[last], at[first], owner[first]
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(blob[a:b], s) for a, b, s in zip(
        lo.tolist(), (hi + span).tolist(), ((at - lo) * 1024 + hi - lo).tolist(), strict=True)], _U)
    text = np.array([i for i, _, _ in parts])[owner]
    shift = np.array([o for _, o, _ in parts])[owner] - begin[owner]
    return text, grams[at].view(np.int64), digests.view(np.int64), lo + shift, hi + shift, at + shift


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))


def anchored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, s, id, key, lo, hi, at) of all segments."""
    def run(batches):
        hashes = PrefixHashes()
        for batch in pieces(batches):
            for text, k, s, lo, hi, at in segments([t or b"" for t in batch.column("text").to_pylist()], hashes):
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(s), batch.column("id").take(own), batch.column("key").take(own),
                     *(pa.array(x.astype(np.int32)) for x in (lo, hi, at))], names=["k", "s", "id", "key", "lo", "hi", "at"])

    kind = docs.schema[key].dataType.simpleString()
    return _keyed(docs, key).where(F.octet_length("text") >= SPAN).mapInArrow(
        run, f"k long, s long, id {kind}, key long, lo int, hi int, at int")


# ---- the suffix sort of a block

class Suffixes:
    """Suffixes of ``data`` at ``start``, of at most ``length`` bytes, sorted within groups (which lie one after another)."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> None:
        self.data, self.start, self.length = data, start, length
        self.first = np.searchsorted(group, group, "left")
        self.size = np.searchsorted(group, group, "right") - self.first
        self.joined = np.append(group[1:] == group[:-1], False) if len(group) else np.zeros(0, bool)
        for seed in range(1, 64):
            self.hashes = PrefixHashes(seed)
            with np.errstate(over="ignore"):
                self.sums = self.hashes.over(data)
                self.order = self._sorted()
                x, y = self.order[:-1], self.order[1:]
                self.common = np.append(np.where(self.joined[:-1], self.extension(x, y), 0), 0)
            if self._right():
                return
        raise RuntimeError("no hash without collisions found")

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y have in common, by binary search over the hashes."""
        most = np.minimum(self.length[x], self.length[y])
        out = np.zeros(len(x), np.int64)
        x, y, back = self.start[x], self.start[y], self.hashes.back
        step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
        while step:
            some = np.flatnonzero(out + step <= most)
            a, b = x[some] + out[some], y[some] + out[some]
            same = (self.sums[a + step] - self.sums[a]) * back[a] == (self.sums[b + step] - self.sums[b]) * back[b]
            out[some[same]] += step
            step >>= 1
        return out

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones by number."""
        same = self.extension(x, y)
        end = same == np.minimum(self.length[x], self.length[y])
        a = self.data[np.minimum(self.start[x] + same, len(self.data) - 1)]
        b = self.data[np.minimum(self.start[y] + same, len(self.data) - 1)]
        by_end = np.where(self.length[x] != self.length[y], self.length[x] < self.length[y], x < y)
        return np.where(end, by_end, a < b)

    def _sorted(self) -> np.ndarray:
        """Mergesort of all groups at a time: each element's place is its own plus its rank in the run beside its run."""
        order = np.arange(len(self.start))
        width, longest = 1, int(self.size.max(initial=1))
        while width < longest:
            at = np.flatnonzero(self.size > width)
            first, size = self.first[at], self.size[at]
            run, own = np.divmod(at - first, width)
            other = run ^ 1
            begin = first + other * width
            low, high = np.zeros(len(at), np.int64), np.clip(size - other * width, 0, width)
            while len(todo := np.flatnonzero(low < high)):
                mid = (low[todo] + high[todo]) >> 1
                less = self.before(order[begin[todo] + mid], order[at[todo]])
                low[todo[less]] = mid[less] + 1
                high[todo[~less]] = mid[~less]
            merged = order.copy()
            merged[first + (run & ~1) * width + own + low] = order[at]
            order, width = merged, width * 2
        return order

    def _right(self) -> bool:
        """Whether the neighbours' bytes bear out what the hashes said."""
        some = np.flatnonzero(self.joined)
        x, y, n = self.order[some], self.order[some + 1], self.common[some]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(self.data[np.repeat(self.start[x], n) + offset], self.data[np.repeat(self.start[y], n) + offset]):
            return False
        more = n < np.minimum(self.length[x], self.length[y])
        x, y, n = x[more], y[more], n[more]
        return bool(np.all(self.data[self.start[x] + n] < self.data[self.start[y] + n]))

    def stretches(self, least: int) -> np.ndarray:
        """Per suffix the number of its stretch: suffixes of a group that have ``least`` bytes in common."""
        ends = ~self.joined | (self.common < least)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(ends) - ends
        return out


def repeated_windows(texts: list[bytes], group: np.ndarray, before: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For segments of groups (in order) with ``before`` bytes before their anchor: a row per segment, a column per distance d,
    whether the window that starts d bytes before the anchor is also in another segment of the group."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    anchor = np.cumsum(size) - size + before
    behind = size - before
    right = Suffixes(data, anchor, np.minimum(behind, span), group)
    left = Suffixes(data[::-1], len(data) - anchor, np.minimum(before, span), group)
    out = np.zeros((len(texts), span - gram + 1), bool)
    for d in range(span - gram + 1):
        has = np.flatnonzero((before >= d) & (behind >= span - d))
        code = right.stretches(span - d)[has] * len(texts) + left.stretches(d)[has]
        _, where, count = np.unique(code, return_inverse=True, return_counts=True)
        out[has, d] = count[where] > 1
    return out


def _sorted_marks(found: DataFrame) -> DataFrame:
    """(id, key, lo, hi) of repeated windows in the single segments of ``found`` (k, n, id, key, lo, at, seg)."""
    def of(t: pa.Table):
        group = t.column("k").to_numpy()
        lo, at = t.column("lo").to_numpy().astype(np.int64), t.column("at").to_numpy().astype(np.int64)
        same = repeated_windows(t.column("seg").to_pylist(), group, at - lo)
        same[t.column("n").to_numpy() > 1] = False
        edge = np.zeros((len(same), same.shape[1] + 2), np.int8)
        edge[:, 1:-1] = same
        step = np.diff(edge, axis=1)
        row, near = np.nonzero(step == 1)
        far = np.nonzero(step == -1)[1] - 1
        own = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [t.column("id").take(own).combine_chunks(), t.column("key").take(own).combine_chunks(),
             pa.array((at[row] - far).astype(np.int32)), pa.array((at[row] - near).astype(np.int32))],
            names=["id", "key", "lo", "hi"])

    def run(batches):
        held = None
        for batch in batches:  # in the order of k; the last k may go on in the next batch
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            k = t.column("k").to_numpy()
            end = int(np.searchsorted(k, k[-1], "left"))
            if end:
                yield of(t.slice(0, end).combine_chunks())
            held = t.slice(end)
        if held is not None and held.num_rows:
            yield of(held.combine_chunks())

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = found.schema["id"].dataType.simpleString()
    return found.select("k", "n", "id", "key", "lo", "at", "seg").repartition(parts, "k").sortWithinPartitions(
        "k").mapInArrow(run, f"id {kind}, key long, lo int, hi int")


def _counted_marks(found: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: windows are compared by their digests."""
    start = F.explode(F.sequence("lo", "hi"))
    windows = found.select("k", "n", "id", "key", "lo", "at", "seg", start.alias("start")).select(
        "k", "n", "id", "key", "start", (F.col("at") - F.col("start")).alias("d"),
        F.unhex(F.md5(F.expr(f"substring(seg, start - lo + 1, {SPAN})"))).alias("w"))
    twice = windows.groupBy("k", "d", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(
        F.col("k").alias("k_"), F.col("d").alias("d_"), F.col("w").alias("w_"))
    return windows.where("n = 1").join(twice, (F.col("k") == F.col("k_")) & (F.col("d") == F.col("d_")) & (
        F.col("w") == F.col("w_"))).select("id", "key", F.col("start").alias("lo"), F.col("start").alias("hi"))


# ---- all texts

def _fetched(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` segments with their bytes, ``seg``."""
    lists = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("k", "n", "m", "lo", "hi", "at")).alias("parts"))
    lists = lists.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "parts").hint("merge")
    met = _keyed(docs, key).join(lists, (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")))
    one = met.select("id", "key", "text", F.explode("parts").alias("x"))
    return one.select("id", "key", "x.*", F.expr(f"substring(text, x.lo + 1, x.hi - x.lo + {SPAN})").alias("seg"))


def repeats(docs: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(id, key, lo, hi), distinct: windows that start from lo to hi in the text of id, whose hash is ``key``, are repeated."""
    all_rows = store(anchored(docs, key), "suffix-anchors")
    keys = all_rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("low"), F.max("s").alias("high"))
    # sums by anchor are written, so that a join reads both sides from a shuffle of their own and hot anchors can be split
    keys = store(keys.where("c > 1").select(F.col("k").alias("of"), (F.col("low") != F.col("high")).alias("differ")), "suffix-keys")
    met = store(all_rows.join(keys, F.col("k") == F.col("of")).drop("of"), "suffix-met")
    place = ["id", "key", "lo", "hi"]
    marks = met.where("not differ").select(*place)
    differ = met.where("differ")
    # one segment of each kind; `first` takes all columns from one row
    kinds = store(differ.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), *[
        F.first(c).alias(c) for c in (*place, "at")]), "suffix-kinds")
    many = kinds.where("n > 1").select(F.col("k").alias("k_"), F.col("s").alias("s_"))
    marks = marks.union(differ.join(many, (F.col("k") == F.col("k_")) & (F.col("s") == F.col("s_"))).select(*place))
    sizes = store(kinds.groupBy(F.col("k").alias("k_")).agg(F.count(F.lit(1)).alias("m")), "suffix-sizes")
    wanted = kinds.join(sizes, F.col("k") == F.col("k_")).select("k", "n", "m", *place, "at")
    found = store(_fetched(docs, wanted, key), "suffix-segments")
    marks = marks.union(store(_sorted_marks(found.where(F.col("m") <= block)), "suffix-sorted"))
    if not found.where(F.col("m") > block).isEmpty():
        marks = marks.union(_counted_marks(found.where(F.col("m") > block)))
    return marks.distinct()


def removed_runs(lo: np.ndarray, hi: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes that windows starting from each lo to each hi cover."""
    order = np.argsort(lo)
    start, end = lo[order], np.maximum.accumulate(hi[order] + span)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def without_repeats(docs: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``removed``, the maximal runs (start, end) of repeated bytes, and ``kept``, the other bytes (null text: empty)."""
    marks = store(repeats(docs, key, block), "suffix-marks").groupBy("id", "key").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    names = {n: free_name(docs, n) for n in ("mark_id", "mark_key", "lo", "hi", "bytes", "removed", "kept")}
    marks = marks.select(F.col("id").alias(names["mark_id"]), F.col("key").alias(names["mark_key"]),
                         F.col("lo").alias(names["lo"]), F.col("hi").alias(names["hi"])).hint("merge")
    met = docs.join(marks, (F.xxhash64("text") == F.col(names["mark_key"])) & F.col(key).eqNullSafe(
        F.col(names["mark_id"])), "left").drop(names["mark_id"], names["mark_key"])
    met = met.withColumn(names["bytes"], F.col("text").cast("binary"))
    held = [met.columns.index(names[c]) for c in ("bytes", "lo", "hi")]
    stays = [i for i in range(len(met.columns)) if i not in held]

    def run(batches):
        run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches):
            removed, kept = [], []
            for text, lo, hi in zip(*(batch.column(i) for i in held), strict=True):
                text = text.as_py() or b""
                if not lo.is_valid:
                    removed.append([])
                    kept.append(text)
                    continue
                start, end = (x.tolist() for x in removed_runs(*(x.values.to_numpy().astype(np.int64) for x in (lo, hi))))
                removed.append([{"start": a, "end": b} for a, b in zip(start, end, strict=True)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in stays), pa.array(removed, run_type), pa.array(kept, pa.binary())],
                names=[*(batch.schema.names[i] for i in stays), names["removed"], names["kept"]])

    runs = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
    schema = T.StructType([*(met.schema.fields[i] for i in stays)]).add(names["removed"], runs).add(
        names["kept"], T.BinaryType())
    return met.mapInArrow(run, schema)


def op12_suffix_dedup(spark, sf_dir) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
