"""Ranked lexical search (integer BM25), exact, by range-maximum tables over posting lists.

1. Texts become bags of terms (64-bit hashes). Only terms that the items may hold are kept, by a bitmap of fixed size
   (``BITMAP`` bits, whatever the number of items); lengths count all terms.
2. Documents lie in blocks of about ``POSTINGS`` postings, items in blocks of ``ITEMS``; a pair of blocks is one task's work.
3. A block's postings lie term by term in the order of documents. Each term's impacts have a sparse table of maxima, so
   the best posting of a term in any interval of documents is found in two look-ups.
4. An item starts with the interval of all documents of the block. An interval's bound is the sum of its terms' maxima. The
   intervals with the highest bounds are taken first (``WIDTH`` of each item at a time): the interval is split at the document
   with the largest single impact, that document is scored in full, and the two intervals beside it get bounds of their
   own. Intervals that can't reach the item's k-th best score are dropped.
5. One block in sixteen is searched first; an item's k-th best score there is a bound for all others. The blocks' best are merged.

Defined cases: a null text, or one without terms, has none and takes no part, as document or as item; term repeats in
an item count; equal scores go to the smaller id (null last); rows that repeat an id are documents (or items) of their own;
an item whose terms no document has gets no row; an empty table gives an empty result; very long texts are taken in pieces;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import pieces, store, table
from rackpulse.llm.near import Shingler

TOP = 20
#: Postings of a block of documents, items of a block, intervals of an item that are split at a time.
POSTINGS, ITEMS, WIDTH = 1 << 20, 1024, 32
#: Bits of the bitmap of the items' terms, and bytes of a piece of text.
BITMAP, PIECE = 1 << 23, 1 << 20
#: Characters that are in no term; only A-Z are lower-cased.
NO_TERM = ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


# ---- terms

class Terms(Shingler):
    """Hashes of the terms of texts."""

    def __init__(self) -> None:
        super().__init__(1)
        self.white = np.zeros(256, bool)
        for first, last in NO_TERM:
            self.white[first:last + 1] = True

    def _cuts(self, text: bytes) -> Iterator[bytes]:
        """``text`` in pieces that end between terms."""
        data, at = np.frombuffer(text, np.uint8), 0
        while len(text) - at > PIECE:
            gaps = np.flatnonzero(self.white[data[at:at + PIECE]])
            end, span = at + PIECE, PIECE
            while not len(gaps) and end < len(text):  # a term longer than a piece: on to its end
                gaps = np.flatnonzero(self.white[data[end:end + span]]) + end - at
                end += span
            cut = at + int(gaps[-1]) + 1 if len(gaps) else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, hash) of each term's place."""
        owners, hashes, held, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [], 0
        parts = [(i, p) for i, t in enumerate(texts) for p in (self._cuts(t) if len(t) > PIECE else (t,))]
        for at, (i, p) in enumerate(parts):
            held.append((i, p))
            size += len(p)
            if size >= PIECE or at == len(parts) - 1:
                data = np.frombuffer(b" " + b" ".join(p for _, p in held) + b" ", np.uint8)
                white = self.white[data]
                starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
                ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
                with np.errstate(over="ignore"):
                    hashes.append(self._hash(data, starts, ends))
                bounds = np.cumsum([len(p) + 1 for _, p in held])
                owners.append(np.array([i for i, _ in held], np.int64)[np.searchsorted(bounds, starts, "right")
                                                                      if len(starts) else starts])
                held, size = [], 0
        return np.concatenate(owners), np.concatenate(hashes)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BITMAP - 1)


def bags(rows: DataFrame, key: str, wanted: Broadcast | None = None) -> DataFrame:
    """(row, id, n, terms, tfs) of every row with a term. ``row`` is a number of its own; ``wanted`` is the bitmap of the
    terms to keep."""
    def run(batches):
        made, first = Terms(), TaskContext.get().partitionId() << 33
        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            owner, h = made.of(texts)
            n = np.bincount(owner, minlength=len(texts))
            if wanted is not None:
                slot = _slot(h)
                some = (wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                owner, h = owner[some], h[some]
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(h))).astype(np.int32)
            offsets = np.searchsorted(owner[at], np.arange(len(texts) + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                pa.array(first + np.arange(len(texts))), batch.column("id"), pa.array(n),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[at].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf))], names=["row", "id", "n", "terms", "tfs"])
            first += len(texts)
            yield out.filter(pa.array(n > 0))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"row long, id {kind}, n long, terms array<long>, tfs array<int>")


def bitmap(terms: DataFrame) -> np.ndarray:
    """The bitmap of ``term``: merged in the cluster; what reaches the driver is BITMAP / 64 words at most."""
    slot = F.shiftrightunsigned("term", 40).bitwiseAND(F.lit(BITMAP - 1).cast("long"))
    words = terms.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


# ---- the search in a block

class Block:
    """Postings in the order of term and document, with the maxima of all stretches of 2^j postings."""

    def __init__(self, code: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> None:
        key = code * n_docs + doc
        order = np.argsort(key)
        self.key, self.doc, self.impact, self.n_docs = key[order], doc[order], impact[order], n_docs
        self.start = np.searchsorted(self.key, np.arange(n_terms + 1) * n_docs)
        longest = int(np.diff(self.start).max(initial=1))
        at = np.arange(len(self.key), dtype=np.int64)
        self.best = [(self.impact << 32) | (0xFFFFFFFF - at)]  # the impact, then the first place that has it
        for j in range(longest.bit_length() - 1):
            wide = self.best[-1].copy()
            wide[:len(wide) - (1 << j)] = np.maximum(wide[:len(wide) - (1 << j)], self.best[-1][1 << j:])
            self.best.append(wide)
        self.best = np.concatenate(self.best) if len(self.key) else np.zeros(1, np.int64)
        self.log = np.zeros(longest + 1, np.int64)
        for j in range(1, longest.bit_length()):
            self.log[1 << j:] = j

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, place) of the best posting in each stretch [a, b)."""
        j = self.log[b - a]
        v = np.maximum(self.best[j * len(self.key) + a], self.best[j * len(self.key) + b - (1 << j)])
        return v >> 32, 0xFFFFFFFF - (v & 0xFFFFFFFF)


class Intervals:
    """Intervals of documents, each with the stretches of its item's postings in it; those without a posting are left out."""

    FIELDS = ("item", "lo", "hi", "bound", "split", "count")
    PAIRS = ("term", "weight", "a", "b")

    def __init__(self, block: Block, item, lo, hi, owner, term, weight, a, b) -> None:
        some = b > a
        owner, self.term, self.weight, self.a, self.b = owner[some], term[some], weight[some], a[some], b[some]
        held, self.count = np.unique(owner, return_counts=True)
        self.item, self.lo, self.hi = item[held], lo[held], hi[held]
        top, place = block.maxima(self.a, self.b)
        top *= self.weight
        at = self.starts()
        if not len(at):
            self.bound = self.split = np.zeros(0, np.int64)
            return
        self.bound = np.add.reduceat(top, at)
        peak = np.maximum.reduceat(top, at)
        first = np.flatnonzero(top == np.repeat(peak, self.count))
        own = np.repeat(np.arange(len(at)), self.count)[first]
        self.split = np.zeros(len(at), np.int64)
        self.split[own[::-1]] = block.doc[place[first[::-1]]]

    def starts(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count

    def take(self, mask: np.ndarray) -> Intervals:
        out = object.__new__(Intervals)
        pairs = np.repeat(mask, self.count)
        for f in self.FIELDS:
            setattr(out, f, getattr(self, f)[mask])
        for f in self.PAIRS:
            setattr(out, f, getattr(self, f)[pairs])
        return out

    def plus(self, other: Intervals) -> Intervals:
        out = object.__new__(Intervals)
        for f in self.FIELDS + self.PAIRS:
            setattr(out, f, np.concatenate([getattr(self, f), getattr(other, f)]))
        return out


class Best:
    """Each item's k best documents so far, and what a document must reach."""

    def __init__(self, floor: np.ndarray, k: int, n_docs: int) -> None:
        self.k, self.floor, self.n_docs = k, floor, n_docs
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.least, self.last = floor.copy(), np.full(len(floor), n_docs)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        stays = rank < self.k
        self.item, self.score, self.doc = item[stays], score[stays], doc[stays]
        full = rank == self.k - 1
        full[full] = score[full] >= self.floor[item[full]]
        self.least[item[full]] = score[full]
        self.last[item[full]] = np.where(score[full] > self.floor[item[full]], doc[full], self.n_docs)

    def open(self, x: Intervals) -> np.ndarray:
        least = self.least[x.item]
        return (x.bound > least) | ((x.bound == least) & (x.lo < self.last[x.item]))


def search(block: Block, item: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int = TOP,
           width: int = WIDTH) -> Best:
    """The best documents of a block for items 0.. (in order), given as (item, term, weight) rows. ``floor``: per item a score
    that k documents elsewhere reach."""
    n = len(floor)
    best = Best(floor, k, block.n_docs)
    zero, end = np.zeros(n, np.int64), np.full(n, block.n_docs, np.int64)
    pool = Intervals(block, np.arange(n), zero, end, item, term, weight, block.start[term], block.start[term + 1])
    while len(pool.item):
        order = np.lexsort((-pool.bound, pool.item))
        sorted_item = pool.item[order]
        now = np.zeros(len(order), bool)
        now[order] = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item) < width
        x, pool = pool.take(now), pool.take(~now)
        owner = np.repeat(np.arange(len(x.item)), x.count)
        want = x.term * block.n_docs + x.split[owner]
        p = np.searchsorted(block.key, want)
        has = (p < x.b) & (block.key[np.minimum(p, len(block.key) - 1)] == want)
        score = np.add.reduceat(np.where(has, x.weight * block.impact[np.minimum(p, len(block.key) - 1)], 0), x.starts())
        best.add(x.item, score, x.split)
        both = Intervals(block, np.concatenate([x.item, x.item]), np.concatenate([x.lo, x.split + 1]),
                         np.concatenate([x.split, x.hi]), np.concatenate([owner, owner + len(x.item)]),
                         np.concatenate([x.term, x.term]), np.concatenate([x.weight, x.weight]),
                         np.concatenate([x.a, p + has]), np.concatenate([p, x.b]))
        pool = pool.plus(both)
        pool = pool.take(best.open(pool))
    return best


# ---- the search

def _searched(words: DataFrame, items: DataFrame, blocks: int, item_blocks: int, sizes: tuple[int, int], k: int) -> DataFrame:
    """(item, id, row, score): of each pair of blocks the best documents. ``words``: bags with their block ``b``; ``items``:
    q, item, floor, term, weight, and the blocks they meet, ``b``."""
    kind = words.schema["id"].dataType.simpleString()
    count, length = sizes

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        ids = docs.column("id").to_pylist()
        rows = docs.column("row").to_numpy()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], rows[i]))
        docs = docs.take(pa.array(order, pa.int64())).combine_chunks()
        terms, tfs = (docs.column(c).combine_chunks() for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(order)), np.diff(terms.offsets.to_numpy()))
        flat, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        asked = asked.sort_by([("item", "ascending"), ("term", "ascending")])
        own_terms, term = np.unique(asked.column("term").to_numpy(), return_inverse=True)
        numbers, first, item = np.unique(asked.column("item").to_numpy(), return_index=True, return_inverse=True)
        floor = asked.column("floor").to_numpy()[first]
        code = np.searchsorted(own_terms, flat)
        some = code < len(own_terms)
        some[some] = own_terms[code[some]] == flat[some]
        m = 75 + 25 * docs.column("n").to_numpy().astype(np.int64)[doc[some]] * count // length
        impact = 1_000_000_000 * tf[some] // (1000 * tf[some] + 12 * m)
        block = Block(code[some], doc[some], impact, len(own_terms), max(1, len(order)))
        best = search(block, item, term, asked.column("weight").to_numpy(), floor, k)
        hit = (best.score > 0) & (best.score >= floor[best.item])  # what others bear out to be too low stays here
        return pa.table({"item": pa.array(numbers[best.item[hit]]), "id": docs.column("id").take(pa.array(best.doc[hit])),
                         "row": docs.column("row").take(pa.array(best.doc[hit])), "score": pa.array(best.score[hit])})

    pairs = words.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))
    return pairs.groupBy("b", "q").cogroup(items.groupBy("b", "q")).applyInArrow(
        run, f"item long, id {kind}, row long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", k: int = TOP,
           postings: int = POSTINGS) -> DataFrame:
    """(item key, rank, document key, score): each item's k best documents."""
    asked = store(bags(items, item_key), "lexical-items")
    each = asked.select(F.col("row").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(
        "item", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("c"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(each))
    words = store(bags(docs, doc_key, wanted), "lexical-words")
    total = words.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    count, length, held = total[0], total[1] or 1, total[2] or 0
    n_items = asked.count()
    blocks, item_blocks = -(-held // postings) or 1, -(-n_items // ITEMS) or 1
    df = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = each.select("term").distinct().join(df, "term").select(
        F.col("term").alias("known"), F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1).cast("double"))).cast(
            "long").alias("w"))
    items_by = store(each.join(known, F.col("term") == F.col("known")).where("w > 0").select(
        "item", F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int").alias("q"), "term",
        (F.col("c") * F.col("w")).alias("weight")), "lexical-weights")
    words = words.where(F.size("terms") > 0).withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def part(first: int, last: int, floors: DataFrame) -> DataFrame:
        met = floors.withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        return store(_searched(words.where(F.col("b").between(first, last - 1)), met, blocks, item_blocks,
                               (count, length), k), "lexical-found")

    start = max(1, blocks // 16)
    found = part(0, start, items_by.withColumn("floor", F.lit(0).cast("long")))
    if start < blocks:
        floor = _best(found, k).where(F.col("rank") == k).select(F.col("item").alias("of"), F.col("score").alias("floor"))
        with_floor = items_by.join(floor, F.col("item") == F.col("of"), "left").drop("of").withColumn(
            "floor", F.coalesce("floor", F.lit(0)))
        found = found.union(part(start, blocks, with_floor))
    names = asked.select(F.col("row").alias("of"), F.col("id").alias("name"))
    return _best(found, k).join(names, F.col("item") == F.col("of")).select(
        F.col("name").alias(item_key), "rank", F.col("id").alias(doc_key), "score")


def op13_lexical_search(spark, sf_dir) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with parts as (
    select 'd' as kind, row_number() over () as r, doc_id as id, text from documents
    union all select 'i', row_number() over (), item_id, text from benchmark
), words as (
    select kind, r, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from parts
), docs as (select r, id, len(ws) as n from words where kind = 'd' and len(ws) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from docs),
bags as (select kind, r, t, count(*) as tf from (select kind, r, unnest(ws) as t from words) group by all),
weights as (
    select t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w
    from bags, total where kind = 'd' group by t, n_docs
), impacts as (
    select b.r, docs.id, b.t, w, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) as impact
    from bags b join docs using (r) join weights using (t), total where kind = 'd'
), scores as (
    select i.r as item, d.r, d.id, sum(i.tf * w * impact)::bigint as score
    from bags i join impacts d using (t) where i.kind = 'i' group by all having sum(i.tf * w * impact) > 0
), ranked as (select *, row_number() over (partition by item order by score desc, id nulls last, r) as rank from scores)
select words.id as item_id, rank::int as rank, ranked.id as doc_id, score
from ranked join words on words.kind = 'i' and words.r = ranked.item where rank <= 20"""
