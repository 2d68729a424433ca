import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rackpulse.llm import merkle
from tests.llm.helpers import counted, documents, lower_az

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h("".join(enc(row[f]) for f in FIELDS))


def climb(nodes, ways):
    """The top of ``nodes``; ways[i] gets (before, after) per level for node i."""
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            ways[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
            at[i] = p // 8
        nodes = [h("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0]


def plain(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, ways = [], {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        ways[name] = [[] for _ in groups[name]]
        tops.append(climb([x[2] for x in groups[name]], ways[name]))
    above = [[] for _ in names]
    root = climb(tops, above)
    for name, top, up in zip(names, tops, above, strict=True):
        for (_, _, own, row), way in zip(groups[name], ways[name], strict=True):
            way = way + up
            folded = own
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                folded = leaf(row | {"text": None if row["text"] is None else lower_az(row["text"])})
            for before, after in way:
                folded = h(before + folded + after)
            out.append((row["doc_id"], own, top, root, h("".join(a + b for a, b in way)), folded, folded == root))
    return out


def run(spark, rows):
    changed = {"text": F.translate("text", merkle.UPPER, merkle.UPPER.lower())}
    got = merkle.verified(documents(spark, rows), changed=changed, where=F.pmod(F.crc32(
        F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0)
    dicts = [dict(zip(("doc_id", "text", "lang", "source"), (*r, *([None] * (4 - len(r)))), strict=True)) for r in rows]
    return got, [d | {"n_chars": None if d["text"] is None else len(d["text"])} for d in dicts]


def test_equals_plain_version(spark):
    rows = [(i * 7 - 300 if i % 2 else i << 40, f"Text {i} Ä", ("en", "de", None, "日本")[min(3, i % 7)], f"s{i % 3}")
            for i in range(700)]
    rows += [(5, None, "en"), (6, "", "one"), (None, "Nobody", "en"), (None, "Someone", "en"), (None, None, None)]
    rows += [(77, "Same", "en")] * 40 + [(77, f"Other {i}", "en") for i in range(30)] + [(-5, "MIN", "en"), (1 << 62, "MAX", "en")]
    got, dicts = run(spark, rows)
    want = plain(dicts)
    assert len(want) == len(rows) and counted(got.collect()) == counted(want)
    assert {r.verified for r in got.collect()} == {True, False}


def test_levels_of_every_height(spark):
    for n in (1, 9, 64, 513):
        got, dicts = run(spark, [(i, f"t{i}", "en") for i in range(n)])
        assert counted(got.collect()) == counted(plain(dicts)), n


def test_manifest_and_empty_table(spark):
    rows = merkle.leaves(documents(spark, [(1, "a", "en"), (2, "b", None), (3, "c", "en")]))
    made = merkle.manifest(merkle.store(rows, "t"))
    assert {(r.name, r.n_leaves) for r in made.subroots().collect()} == {("en", 2), (None, 1)}
    subroots = {r.name: r.subroot for r in made.subroots().collect()}
    assert [r.root for r in made.root().collect()] == [h(subroots[None] + subroots["en"])]
    got, _ = run(spark, [])
    assert got.collect() == []


@pytest.mark.parametrize("total, height", [(0, 0), (1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (8 ** 12, 12), (8 ** 12 + 1, 13)])
def test_height(spark, total, height):
    assert spark.range(1).select(merkle._height(F.lit(total).cast("long"))).first()[0] == height
