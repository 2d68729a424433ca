"""Exact Jaccard join of documents on word 5-grams, by grouped prefixes.

A document's set holds the hashes of its distinct runs of five words. Links are pairs with
``|x and y| >= 0.8 * |x or y|``; the result is the component of each document.

1. Documents with equal sets form a class; only one of a class goes on.
2. With the hashes as the order of all shingles, two linked sets share at least k of their first
   ``n - ceil(0.8 * n) + k``. Classes with the same size and the same prefix form a group, which sends its prefix once.
3. Shingles that two groups share are found in a shuffle by shingle. A group can only have links if k of its
   prefix are shared (k for the smallest possible partner), or if it has several classes. This is repeated among those
   that are left. Of a group's shared shingles, all but the k - 1 most frequent suffice to meet a partner; groups
   that share one of these, and whose sizes allow a link, step by step, form a home.
4. Homes are expanded: the texts of their classes come together, in blocks of bounded size where a home is large (each
   pair of blocks once). A block joins its sets exactly: candidates by the rarest shingles of each set, length filter, then
   the intersection of the whole sets. A block gives the number of links of each class (documents of a class count each) and,
   of the links, those that connect; so all links are found and counted, and no list of pairs goes out.
5. Connecting links are merged into components, numbers of links summed.

Defined cases: a text of one to four words is one shingle as a whole; without words (or null) a document has size 0 and is a
component of its own; rows that repeat an id are documents of their own (a component's id is the smallest id in it, null
only if all are); an empty table gives an empty result; columns other than doc_id and text are ignored (and kept, by
``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import pieces, store, table

K = 5
PERCENT = 80
#: Prefixes are longer than they must be by this share of the set (in per cent), and so many shared shingles are asked for.
EXTRA = 10
#: Bounds of a block: classes, and shingles of all of them.
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1 << 19
_CHUNK = 1 << 20
_U = np.uint64
_B, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


# ---- shingle sets

class Shingler:
    """Sets of shingle hashes, for many texts at a time."""

    def __init__(self, k: int = K) -> None:
        rng = np.random.Generator(np.random.PCG64(5))
        lower = np.arange(256)
        lower[65:91] += 32
        self.k, self.powers, self.back = k, np.ones(1, _U), np.ones(1, _U)
        self.letters = rng.integers(1, 1 << 63, 256).astype(_U)[lower]
        self.white = np.isin(np.arange(256), [32, *range(9, 14)])

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= _CHUNK:
                yield from self._sets(held)
                held, size = [], 0
        if held:
            yield from self._sets(held)

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        k = self.k
        with np.errstate(over="ignore"):
            data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
            white = self.white[data]
            starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
            ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
            words = self._hash(data, starts, ends)
            bounds = np.cumsum([len(t) + 1 for t in texts])  # where each text's last white space is
            last = np.searchsorted(starts, bounds, "left")
            first = np.concatenate([[0], last[:-1]])
            runs = np.zeros(max(0, len(words) - k + 1), _U)
            for j in range(k):
                runs = self._mix(runs + words[j:j + len(runs)])
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                if b - a >= k:
                    yield np.unique(runs[a:b - k + 1])
                else:
                    h = np.full(min(1, b - a), b - a, _U)
                    for w in words[a:b]:
                        h = self._mix(h + w)
                    yield h

    @staticmethod
    def _mix(h):
        h = (h ^ (h >> _U(33))) * _M1
        h = (h ^ (h >> _U(29))) * _M2
        return h ^ (h >> _U(32))

    def _hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the words from sums over the whole, each brought back to power 0 at its start."""
        while len(self.powers) <= len(data):
            n = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * _U(pow(int(_B), n, 1 << 64))])
            self.back = np.concatenate([self.back, self.back * _U(pow(int(_B), -n, 1 << 64))])
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.letters[data] * self.powers[:len(data)], out=sums[1:])
        return self._mix((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(_U))


def least_overlap(n, percent: int = PERCENT):
    """ceil(percent * n / 100)"""
    return -(-n * percent // 100)


def prefix_of(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n = len(hashes)
    return hashes[:n - least_overlap(n, percent) + -(-n * EXTRA // 100)]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").to_pylist()]


def _group_key(prefix: np.ndarray, n: int) -> int:
    return xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n) - (1 << 63)


def document_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n, class, grp) per document; ``class`` is the digest of its set, ``grp`` of size and prefix."""
    def run(batches):
        shingler = Shingler()
        for batch in pieces(batches):
            n, cls, grp = [], [], []
            for s in shingler.sets(_texts(batch)):
                n.append(len(s))
                cls.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                grp.append(_group_key(prefix_of(s, percent), len(s)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n": pa.array(n, pa.int32()),
                "class": pa.array(cls, pa.string()), "grp": pa.array(grp, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text")
                       ).mapInArrow(run, f"doc_id {kind}, text_key long, n int, class string, grp long")


def _prefix_rows(docs: DataFrame, percent: int) -> DataFrame:
    """(h, grp): the prefixes of all groups, from each task once."""
    def run(batches):
        shingler, sent = Shingler(), set()
        for batch in pieces(batches):
            hashes, groups, sizes = [], [], []
            for s in shingler.sets(_texts(batch)):
                p = prefix_of(s, percent)
                g = _group_key(p, len(s))
                if len(s) and g not in sent:
                    sent.add(g)
                    hashes.append(p)
                    groups.append(g)
                    sizes.append(len(p))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(hashes)), pa.array(np.repeat(np.array(groups, np.int64), sizes))],
                    names=["h", "grp"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long, grp long")


def _shared(rows: DataFrame) -> DataFrame:
    """Of (h, grp) the distinct rows whose h has two groups at least."""
    def run(batches):
        held_h = held_g = np.zeros(0, np.int64)
        for batch in batches:  # in the order of h and grp; the last h may go on in the next batch
            h = np.concatenate([held_h, batch.column("h").to_numpy()])
            g = np.concatenate([held_g, batch.column("grp").to_numpy()])
            at = int(np.searchsorted(h, h[-1], "left"))
            if at:
                yield of(h[:at], g[:at])
            h, g = h[at:], g[at:]
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            held_h, held_g = h[new], g[new]
            if len(held_h) > 1 << 16:  # a shingle of very many groups: they go out as they come
                yield pa.RecordBatch.from_arrays([pa.array(held_h[:-1]), pa.array(held_g[:-1])], names=["h", "grp"])
                held_h, held_g = held_h[-2:], held_g[-2:]
        if len(held_h):
            yield of(held_h, held_g)

    def of(h, g):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        h, g = h[new], g[new]
        several = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        several[1:] |= same
        several[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(h[several]), pa.array(g[several])], names=["h", "grp"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "h").sortWithinPartitions("h", "grp").mapInArrow(run, "h long, grp long")


def _asked(n: Column, percent: int) -> Column:
    """Shared prefix shingles that a set of n needs to have a partner: k of the smallest possible partner."""
    return F.ceil(F.ceil(n * percent / F.lit(100)) * EXTRA / F.lit(100))


# ---- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of ``edges`` (a, b) the smallest node it is connected with.

    Each round points every node to its smallest neighbour and joins the two; the rounds' pointers are then composed.
    """
    rounds = []
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                  "cc-edges")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("up"))
        hop = up.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        up = store(up.join(hop, F.col("up") == F.col("n2")).select("node", F.col("up2").alias("root")), "cc-up")
        rounds.append(up)
        x, y = up.toDF("a", "ra"), up.toDF("b", "rb")
        edges = store(edges.join(x, "a").join(y, "b").where("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds.pop()
    while rounds:  # the roots of one round are nodes of the next, or are through
        later = out.toDF("n2", "r2")
        out = store(rounds.pop().join(later, F.col("root") == F.col("n2"), "left").select(
            "node", F.coalesce("r2", "root").alias("root")), "cc-roots")
    return out


# ---- homes

def _homes(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(grp, home) of the groups that may have links."""
    shared = store(_shared(rows), "near-shared")
    for _ in range(2):
        counts = shared.groupBy("grp").agg(F.count(F.lit(1)).alias("held"))
        alive = groups.join(counts, "grp", "left").where(
            (F.col("classes") > 1) | (F.col("held") >= _asked(F.col("n"), percent))).select("grp")
        alive = store(alive, "near-alive")
        shared = store(_shared(shared.join(alive, "grp", "left_semi")), "near-shared")
    # the rarest shared shingle of two linked sets is among the rarest of each: all but the k - 1 most frequent ones
    sized = shared.join(groups.join(alive, "grp", "left_semi").select("grp", "n"), "grp")
    known = sized.join(shared.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h")
    own = Window.partitionBy("grp")
    head = known.withColumn("place", F.row_number().over(own.orderBy("df", "h"))).withColumn(
        "held", F.count(F.lit(1)).over(own)).where(F.col("place") <= F.col("held") - _asked(F.col("n"), percent) + 1)
    edges = store(_neighbours(head.select("h", "n", "grp"), percent).distinct(), "near-edges")
    alive = edges.select(F.col("a").alias("grp")).union(edges.select("b")).union(
        groups.where("classes > 1").select("grp")).distinct()
    roots = components(edges)
    return alive.join(roots, F.col("grp") == F.col("node"), "left").select(
        "grp", F.coalesce("root", "grp").alias("home"))


def _neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): of (h, n, grp) the groups next to each other in the order of size, among those of one h, if their sizes
    allow a link. Any two groups that share an h and whose sizes allow a link are joined by such steps."""
    def run(batches):
        before = np.zeros((3, 0), np.int64)
        for batch in batches:  # in the order of h, n and grp
            rows = np.concatenate([before, [batch.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "grp")]], axis=1)
            before = rows[:, -1:]
            h, n, g = rows
            step = (h[1:] == h[:-1]) & (g[1:] != g[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
            pairs = np.unique(np.stack([g[:-1][step], g[1:][step]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h").sortWithinPartitions("h", "n", "grp").mapInArrow(run, "a long, b long")


class _Sets:
    """Union-find over numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(sets: list[np.ndarray], block: np.ndarray, percent: int = PERCENT, known: _Sets | None = None
                ) -> Iterator[tuple[int, np.ndarray]]:
    """All links among ``sets``, each once, as (i, linked sets behind i): of pairs within a block if there is one block, else of
    pairs across blocks. Pairs that are connected in ``known`` already are left out."""
    size = np.array([len(s) for s in sets])
    n, flat = len(sets), np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    by_code = np.argsort(code, kind="stable")
    post, post_at = owner[by_code], np.concatenate([[0], np.cumsum(df)])
    own_at = np.concatenate([[0], np.cumsum(size)])
    heads = []
    for i in range(n):  # the rarest shingles first
        c = code[own_at[i]:own_at[i + 1]]
        heads.append(c[np.argsort(df[c], kind="stable")][:len(c) - least_overlap(len(c), percent) + 1])
    across, mark = len(set(block.tolist())) > 1, np.zeros(len(df), bool)
    for i in range(n):
        t = heads[i][df[heads[i]] > 1]
        if not len(t):
            continue
        count = df[t]
        idx = np.repeat(post_at[t] - np.cumsum(count) + count, count) + np.arange(count.sum())
        near = np.unique(post[idx])
        # both sets of a link find each other by their rarest shingles: the first of them is enough
        near = near[(near > i) & (size[near] * 100 >= size[i] * percent) & (size[near] * percent <= size[i] * 100)]
        if across:
            near = near[block[near] != block[i]]
        if known is not None and len(near):
            mine = known.root(i)
            near = np.array([j for j in near.tolist() if known.root(j) != mine], np.int64)
        if not len(near):
            continue
        mark[code[own_at[i]:own_at[i + 1]]] = True
        for part in np.array_split(near, -(-int(size[near].sum()) // (1 << 21))):
            length = size[part]
            begin = np.cumsum(length) - length
            idx = np.repeat(own_at[part] - begin, length) + np.arange(length.sum())
            both = np.add.reduceat(mark[code[idx]], begin, dtype=np.int64)
            linked = part[both * 100 >= percent * (length + size[i] - both)]
            if len(linked):
                yield i, linked
        mark[code[own_at[i]:own_at[i + 1]]] = False


def _links(members: DataFrame, percent: int, count: bool) -> DataFrame:
    """(a, b, partners) of each home. With a ``b``: connecting links between classes; without: ``partners``, the documents that
    those of class ``a`` are linked with in one pair of blocks. ``members``: home, class, n, size, text."""
    total = members.groupBy("home").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    total = store(total.where("c > 1").select(F.col("home").alias("of"), blocks.alias("blocks")), "near-homes")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    # a class meets every block of its home once
    placed = members.join(total, F.col("home") == F.col("of")).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("home", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own",
                           "class", "size", "text")

    def run(group: pa.Table) -> pa.Table:
        first = {c: i for i, c in reversed(list(enumerate(group.column("class").to_pylist())))}
        group = group.take(pa.array(sorted(first.values())))
        sets = list(Shingler().sets([t.as_py() or b"" for t in group.column("text")]))
        names = group.column("class").to_pylist()
        weight, partners, found = group.column("size").to_numpy(), np.zeros(len(sets), np.int64), _Sets(len(sets))
        pairs = []
        for i, linked in block_links(sets, group.column("own").to_numpy(), percent, None if count else found):
            partners[i] += weight[linked].sum()
            partners[linked] += weight[i]
            pairs += [(i, j) for j in linked.tolist() if found.join(i, j)]
        some = np.flatnonzero(partners).tolist() if count else []
        return pa.table({"a": pa.array([names[i] for i, _ in pairs] + [names[i] for i in some], pa.string()),
                         "b": pa.array([names[j] for _, j in pairs] + [None] * len(some), pa.string()),
                         "partners": pa.array([0] * len(pairs) + partners[some].tolist(), pa.int64())})

    return placed.groupBy("home", "x", "y").applyInArrow(run, "a string, b string, partners long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_key, root) of every document; ``n_links`` is the number of documents it is
    linked with, those of its own class included (without ``count`` pairs that are connected already aren't checked, and it is too
    small); ``root`` names the component, null without words."""
    spread = docs.select("doc_id", "text")
    found = store(document_classes(spread, percent), "near-documents")
    some = found.where("n > 0")
    classes = store(some.groupBy("class").agg(F.first("n").alias("n"), F.first("grp").alias("grp"),
                                              F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id"),
                                              F.min(F.struct("doc_id", "text_key")).alias("one")), "near-classes")
    groups = classes.groupBy("grp").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    homes = _homes(_prefix_rows(spread, percent), groups, percent)
    wanted = store(classes.join(homes, "grp").select("class", "n", "size", "home", F.col("one.doc_id").alias("id"),
                                                     F.col("one.text_key").alias("key")), "near-wanted")
    texts = spread.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    # texts meet unbounded lists of keys by sorting, at every size: such a list is never broadcast
    members = texts.join(wanted.hint("merge"), (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    links = store(_links(members.select("home", "class", "n", "size", "text"), percent, count), "near-links")
    roots = components(links.where(F.col("b").isNotNull()).select("a", "b"))
    partners = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("by")).agg(F.sum("partners").alias("partners"))
    labelled = classes.join(roots, F.col("class") == F.col("node"), "left").join(
        partners, F.col("class") == F.col("by"), "left").select(
        F.col("class").alias("of"), "first_id", F.coalesce("root", "class").alias("root"),
        (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).alias("linked"))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = labelled.select("of", "root", "linked").join(ids, "root")
    return (found.join(by_class, F.col("class") == F.col("of"), "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.coalesce("linked", F.lit(0)).alias("n_links"), "text_key", "root"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, of which each component keeps one: that of the smallest id (null last), and of the
    smallest text digest where rows repeat it; rows that agree in both stay once. Documents without words are kept."""
    found = store(near_duplicates(docs, percent, count=False).where("n_shingles > 0").select("doc_id", "text_key", "root"), "near-roots")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    several = found.groupBy("root").agg(F.min(order).alias("stays"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = found.join(several.withColumnRenamed("root", "of"), F.col("root") == F.col("of"))
    gone = met.where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))))
    gone = store(gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "near-gone")
    left = _without(docs, gone)
    twice = store(found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).count().where("count > 1")
                  .drop("count"), "near-twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, (F.xxhash64(docs["text"]) == twice["__key"]) & docs["doc_id"].eqNullSafe(twice["__id"]),
                     "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(left, twice).union(once)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keys = keys.hint("merge")
    return docs.join(keys, (F.xxhash64(docs["text"]) == keys["__key"]) & docs["doc_id"].eqNullSafe(keys["__id"]),
                     "left_anti")


def op8_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "root")
