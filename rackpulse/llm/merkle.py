"""Merkle manifest of a data set, by bitmap rank.

Every row is a leaf: the SHA-256 of its fields. Leaves of a group ascend by id; runs of eight nodes become their digest until
one node, the group's subroot, is left; subroots in the order of their groups give the root the same way.

1. Ids become bitmaps per group: words of 64 ids, merged from all tasks by ``bit_or``; only words with a bit set are kept, so
   dense and sparse ids are both compressed.
2. A popcount directory holds the ids before each word: prefix sums over words, over stretches of 2^16 words, of 2^32
   words and so on, so no window ever spans more than 2^16 rows.
3. A leaf's place is a rank query: the directory's count and the bits below its own. Leaves are never sorted.
4. Places key arrays of 512 slots, each of which gives three levels at once; the arrays' nodes go on in the same way.
5. From the root down, each array hands its slots the siblings above them: a row's proof.

Defined cases: a null field is ``-``, an empty text ``0:``; a null group comes before all others, null ids before all ids; rows
that repeat an id lie in the order of their leaves (the words that hold them leave the rank query and count by leaf
prefixes, equal rows in blocks, so no task gets all rows of an id); equal rows have equal leaves at places of
their own; a group of one row has its leaf as subroot; an empty table gives an empty result; further columns are ignored.
Subroots are numbered by one window over all groups: one row a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import store, table
from rackpulse.llm.training import remainder

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_BITS, DEPTH = 3, 3
FAN, SLOTS = 1 << FAN_BITS, 1 << (FAN_BITS * DEPTH)
#: Bits of a step of the directory; a word number has 58 bits and a sign.
STEP_BITS, STEPS = 16, 4
#: Word of the rows without an id: before every other word.
_NO_ID = -(1 << 57) - 1
_PATH = "array<struct<before:string,after:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def leaves(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang",
           changed: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, g, word, bit, leaf, altered, part) of every row. ``altered`` is the leaf of the row with ``changed`` fields where
    ``where`` holds, else null; ``part`` tells apart the tasks that read equal rows."""
    new = [(changed or {}).get(f, F.col(f)) for f in fields]
    number = F.col(key).cast("long")
    return rows.select(
        F.col(key).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),
        F.coalesce(F.shiftright(number, 6), F.lit(_NO_ID)).alias("word"),
        F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"), number.isNull().alias("no_id"),
        digest([F.col(f) for f in fields]).alias("leaf"),
        (F.when(where, digest(new)) if where is not None else F.lit(None).cast("string")).alias("altered"),
        F.spark_partition_id().alias("part"))


# ---- places by bitmap rank

def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def directory(rows: DataFrame) -> DataFrame:
    """(g, word, bits, n, base, total): the groups' bitmaps with the number of rows before each word and in the group."""
    words = store(rows.groupBy("g", "word").agg(
        F.coalesce(F.bit_or(F.when(~F.col("no_id"), _bit(F.col("bit")))), F.lit(0).cast("long")).alias("bits"),
        F.count(F.lit(1)).alias("n")), "merkle-words")
    counts = [words.select("g", F.col("word").alias("node"), "n")]
    for _ in range(STEPS - 1):
        counts.append(counts[-1].groupBy("g", F.shiftright("node", STEP_BITS).alias("node")).agg(F.sum("n").alias("n")))
    total = counts[-1].groupBy(F.col("g").alias("of")).agg(F.sum("n").alias("total"))
    above = None
    for level in reversed(counts):
        stretch = [F.col("g")] + ([F.shiftright("node", STEP_BITS)] if above is not None else [])
        before = F.sum("n").over(Window.partitionBy(*stretch).orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
        level = level.select("g", "node", "n", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
        if above is None:
            above = level.join(total, F.col("g") == F.col("of")).drop("of", "n")
            continue
        up = above.select(F.col("g").alias("of"), F.col("node").alias("up"), F.col("base").alias("more"), "total")
        above = level.join(up, (F.col("g") == F.col("of")) & (F.shiftright("node", STEP_BITS) == F.col("up"))).select(
            "g", "node", (F.col("base") + F.col("more")).alias("base"), "total")
    base = above.select(F.col("g").alias("of"), F.col("node").alias("at"), "base", "total")
    return store(words.join(base, (F.col("g") == F.col("of")) & (F.col("word") == F.col("at"))).drop("of", "at"),
                 "merkle-directory")


def places(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(g, total, r, digest, id, altered): every row with its place in its group, from 0."""
    words = words.withColumn("plain", F.col("n") == F.bit_count("bits"))
    d = words.select(F.col("g").alias("of"), F.col("word").alias("at"), "bits", "base", "total", "plain")
    met = rows.join(d, (F.col("g") == F.col("of")) & (F.col("word") == F.col("at")))
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))))
    out = ["g", "total", "r", F.col("leaf").alias("digest"), "id", "altered"]
    plain = met.where("plain").withColumn("r", F.col("base") + below)
    if words.where("not plain").isEmpty():
        return plain.select(*out)
    # ids that several rows have: equal leaves count as blocks, leaves of an id by their first digits
    some = met.where("not plain").withColumn("digits", F.substring("leaf", 1, 4))
    blocks = some.groupBy("g", "word", "bit", "digits", "leaf", "part").agg(
        F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("id", "altered", "base", "total")])
    blocks = store(blocks, "merkle-repeats")
    left = Window.unboundedPreceding, -1
    bins = blocks.groupBy("g", "word", "bit", "digits").agg(F.sum("m").alias("m"))
    bins = bins.select(*[F.col(c).alias(f"{c}_") for c in ("g", "word", "bit", "digits")], F.coalesce(F.sum("m").over(
        Window.partitionBy("g", "word").orderBy("bit", "digits").rowsBetween(*left)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("m").over(Window.partitionBy("g", "word", "bit", "digits").orderBy("leaf", "part").rowsBetween(
        *left)), F.lit(0))
    blocks = blocks.withColumn("inside", inside).join(bins, [
        F.col(c) == F.col(f"{c}_") for c in ("g", "word", "bit", "digits")])
    first = F.col("base") + F.col("before") + F.col("inside")
    return plain.select(*out).union(
        blocks.withColumn("r", F.explode(F.sequence(first, first + F.col("m") - 1))).select(*out))


# ---- levels

def _height(total: Column) -> Column:
    """Levels above ``total`` leaves: the smallest h with 8^h >= total, by the binary digits of total - 1."""
    return F.when(total > 1, F.ceil(F.length(F.bin(total - 1)) / F.lit(FAN_BITS))).otherwise(0).cast("int")


def _next(nodes: Column) -> Column:
    """The digests of the runs of eight."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, FAN_BITS)),
                       lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


@dataclass
class Tree:
    """``rounds[j]``: (g, k, slots, levels, node, total): arrays of 512 nodes of level 3j with the levels above them."""

    rounds: list[DataFrame]

    def tops(self) -> DataFrame:
        """(g, node, total): what remains of each group."""
        return self.rounds[-1].select("g", "node", "total")


def reduce_levels(nodes: DataFrame, name: str) -> Tree:
    """``nodes``: g, total, r, digest and payload columns, which stay with their slots."""
    payload = [c for c in nodes.columns if c not in ("g", "total", "r", "digest")]
    most = nodes.agg(F.max("total")).first()[0] or 1
    rounds, span = [], 1
    while not rounds or span < most:
        slot = F.col("r").bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int")
        arrays = nodes.groupBy("g", F.shiftright("r", FAN_BITS * DEPTH).alias("k")).agg(
            F.array_sort(F.collect_list(F.struct(slot.alias("s"), "digest", *payload))).alias("slots"),
            F.first("total").alias("total"))
        steps = F.least(F.greatest(_height(F.col("total")) - F.lit(DEPTH * len(rounds)), F.lit(0)), F.lit(DEPTH))
        todo = F.slice(F.array(*[F.lit(j) for j in range(DEPTH)]), F.lit(1), steps)
        levels = F.aggregate(todo, F.array("slots.digest"),
                             lambda made, _: F.concat(made, F.array(_next(F.element_at(made, -1)))))
        arrays = store(arrays.select("g", "k", "slots", "total", levels.alias("levels")).select(
            "g", "k", "slots", "total", F.slice("levels", F.lit(1), F.size("levels") - 1).alias("levels"),
            F.element_at(F.element_at("levels", -1), 1).alias("node")), name)
        rounds.append(arrays)
        span, payload = span * SLOTS, []
        nodes = arrays.select("g", "total", F.col("k").alias("r"), F.col("node").alias("digest"))
    return Tree(rounds)


def _siblings(levels: Column, slot: Column) -> Column:
    """The siblings on a slot's way through its array, level by level: those before and those behind, each run as one text."""
    steps = []
    for j in range(DEPTH):
        nodes, at = F.get(levels, F.lit(j)), F.shiftright(slot, FAN_BITS * j)
        own = at.bitwiseAND(F.lit(FAN - 1))
        one = F.struct(F.array_join(F.slice(nodes, at - own + 1, own), "").alias("before"),
                       F.array_join(F.slice(nodes, at + 2, F.lit(FAN - 1) - own), "").alias("after"))
        steps.append(F.when(F.size(levels) > j, F.array(one)).otherwise(F.array().cast(_PATH)))
    return F.concat(*steps)


def hand_down(tree: Tree, above: DataFrame, carry: Sequence[str], last) -> DataFrame:
    """``above``: g, path and the columns ``carry`` for each group's top. ``last(slot, path, *carry)`` gives the struct that
    each slot of the lowest arrays becomes."""
    at = above.withColumn("r", F.lit(0).cast("long"))
    for j in reversed(range(len(tree.rounds))):
        up = at.select(F.col("g").alias("of"), F.col("r").alias("at"), F.col("path").alias("above"), *carry)
        met = tree.rounds[j].join(up, (F.col("g") == F.col("of")) & (F.col("k") == F.col("at")))
        if j:
            def step(x):
                return F.struct((F.col("k") * SLOTS + x["s"]).alias("r"),
                                F.concat(_siblings(F.col("levels"), x["s"]), F.col("above")).alias("path"))
            one = met.select("g", *carry, F.explode(F.transform("slots", step)).alias("x"))
            at = one.select("g", "x.r", "x.path", *carry)
        else:
            def end(x):
                return last(x, F.concat(_siblings(F.col("levels"), x["s"]), F.col("above")), *map(F.col, carry))
            return met.select(F.explode(F.transform("slots", end)).alias("x")).select("x.*")


@dataclass
class Manifest:
    """The trees of the groups, and the tree of their subroots."""

    groups: Tree
    roots: Tree

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return self.roots.tops().select(F.col("node").alias("root"))

    def subroots(self) -> DataFrame:
        """(name, subroot, n_leaves) of each group."""
        name = F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30))
        return self.groups.tops().select(name.alias("name"), F.col("node").alias("subroot"), F.col("total").alias("n_leaves"))

    def proofs(self, last) -> DataFrame:
        """A row per leaf: the fields of ``last(slot, path, subroot, root)``."""
        top = self.roots.tops().select("g", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
        paths = hand_down(self.roots, top, ["root"], lambda x, path, root: F.struct(
            x["name"].alias("g"), path.alias("path"), x["digest"].alias("subroot"), root.alias("root")))
        return hand_down(self.groups, store(paths, "merkle-subroots"), ["subroot", "root"], last)


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of stored ``leaves``."""
    groups = reduce_levels(places(rows, directory(rows)), "merkle-slots")
    tops = groups.tops().select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("node").alias("digest"))
    tops = tops.withColumn("r", F.row_number().over(Window.orderBy("name")).cast("long") - 1)
    tops = store(tops.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("g"))), "merkle-tops")
    return Manifest(groups, reduce_levels(tops, "merkle-root"))


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def verified(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang",
             changed: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Per row its id (named ``key``), leaf, subroot, root, proof_sha256, folded_root and verified: whether the row, with
    ``changed`` fields where ``where`` holds, still folds to the root."""
    found = store(leaves(rows, fields, key, group, changed, where), "merkle-leaves")

    def last(x, path, subroot, root):
        proof = F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)
        return F.struct(x["id"].alias(key), x["digest"].alias("leaf"), subroot.alias("subroot"), root.alias("root"),
                        proof.alias("proof_sha256"), fold(path, F.coalesce(x["altered"], x["digest"])).alias("folded_root"))

    return manifest(found).proofs(last).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir) -> DataFrame:
    lower = F.translate("text", UPPER, UPPER.lower())
    return verified(table(spark, sf_dir, "documents"), changed={"text": lower}, where=remainder(3) == 0)


# ---- DuckDB SQL

def _oracle(levels: int = 8, root_levels: int = 3) -> str:
    def field(c):
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"

    def climb(name, by, count):
        out = []
        for j in range(count):
            run = f"over (partition by {by}p // 8 order by p rows between"
            out.append(f"""{name}s{j} as (select {by}p, n > 1 as up,
                coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') as a,
                coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') as z from {name}{j})""")
            out.append(f"""{name}{j + 1} as (select {by}p // 8 as p,
                case when max(n) > 1 then sha256(string_agg(h, '' order by p)) else max(h) end as h, (max(n) + 7) // 8 as n
                from {name}{j} group by {by}p // 8)""")
        return out

    ctes = ["""crc as (select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i:
                case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)""",
            f"""leaves as (select doc_id, lang, {leaf("text")} as leaf,
                case when xor(list_reduce(list_concat([4294967295::bigint],
                    list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0
                then {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} end as altered
                from documents, crc)""",
            """placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p0
                from leaves)""",
            "n0 as (select lang, p0 as p, leaf as h, count(*) over (partition by lang) as n from placed)"]
    ctes += climb("n", "lang, ", levels)
    ctes.append(f"""r0 as (select lang, row_number() over (order by lang nulls first) - 1 as p, h, count(*) over () as n
                from n{levels})""")
    ctes += climb("r", "", root_levels)
    ctes.append("f0 as (select *, coalesce(altered, leaf) as f, '' as proof from placed)")
    step = """case when up then sha256(a || f || z) else f end as f, case when up then proof || a || z else proof end as proof"""
    for j in range(levels):
        ctes.append(f"""f{j + 1} as (select f{j}.* exclude (f, proof), {step} from f{j} join ns{j}
                on f{j}.lang is not distinct from ns{j}.lang and ns{j}.p = p0 // {8 ** j})""")
    ctes.append(f"""g0 as (select f{levels}.*, r0.p as q, r0.h as subroot from f{levels} join r0
                on f{levels}.lang is not distinct from r0.lang)""")
    for j in range(root_levels):
        ctes.append(f"g{j + 1} as (select g{j}.* exclude (f, proof), {step} from g{j} join rs{j} on rs{j}.p = q // {8 ** j})")
    return "with " + ",\n".join(ctes) + f"""
        select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified
        from g{root_levels}, r{root_levels}"""


ORACLE_SQL = _oracle()
