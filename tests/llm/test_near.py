import random

import numpy as np
import pytest

from rackpulse.llm import near
from tests.llm.helpers import components, documents, prose, shingles


def family(seed, n, size, edits):
    """A text and copies with words changed, in chains."""
    rng = random.Random(seed)
    out = [prose(seed, size, 5000).split()]
    for _ in range(n - 1):
        t = list(rng.choice(out))
        for _ in range(edits):
            t[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def corpus():
    passage = prose(99, 60, 5000)
    texts = [*family(1, 40, 120, 2), *family(2, 15, 300, 6), *family(3, 12, 9, 1)]
    texts += [f"{prose(100 + i, 200, 5000)} {passage}" for i in range(30)]          # share a passage only
    texts += [texts[0].upper(), texts[0], texts[0], "a b c", "a b c", "A  B\tC", "a b", "", None, " \n", "x " * 50]
    texts += [prose(7, 30000, 5000), prose(7, 30000, 5000) + " end"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


def expected(texts):
    return {i: (n, root) for i, (n, root) in enumerate(components(texts))}


def run(spark, texts):
    got = near.near_duplicates(documents(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_components_equal_all_pairs(spark, texts):
    assert run(spark, texts) == expected(texts)


def test_small_chunks_and_blocks_change_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(near, "_CHUNK", 5000)
    monkeypatch.setattr(near, "BLOCK_CLASSES", 7)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 2000)
    assert run(spark, texts) == expected(texts)


def links_by_hand(texts, percent=80):
    sets = [shingles(t) for t in texts]
    return [sum(i != j and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block", [near.BLOCK_CLASSES, 7])
def test_every_link_is_counted(spark, texts, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_CLASSES", block)
    texts = [*texts, *texts[:20], *texts[5:9]]
    got = {r.doc_id: r.n_links for r in near.near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    want = links_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want and max(want) > 10


def test_a_large_family_of_chained_copies(spark):
    texts = family(5, 250, 146, 3)
    assert run(spark, texts) == expected(texts)


def test_sets_do_not_depend_on_their_neighbours():
    shingler = near.Shingler()
    texts = [t.encode() for t in family(4, 5, 50, 3)]
    alone = [next(iter(shingler.sets([t]))) for t in texts]
    together = list(shingler.sets([b"", *texts, b"x y"]))[1:-1]
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert [len(a) for a in alone] == [len(shingles(t.decode())) for t in texts]


def test_repeated_and_null_ids(spark):
    base = prose(1, 50)
    rows = [(5, base), (5, prose(2, 50)), (None, base), (3, base), (3, base), (9, base + " more")]
    got = sorted((tuple(r)[:3] for r in near.near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 46, 3), (5, 46, 5), (None, 46, 3), (3, 46, 3), (3, 46, 3), (9, 47, 3)], key=repr)


def test_keep_one(spark, texts):
    docs = documents(spark, list(enumerate(texts)))
    kept = near.keep_one(docs)
    want = {i for i, (n, root) in expected(texts).items() if n == 0 or i == root}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    base = prose(1, 50)
    odd = documents(spark, [(5, base), (5, base), (5, base + " z"), (None, base), (8, base), (4, ""), (4, "")])
    got = near.keep_one(odd).collect()
    assert sorted((r.doc_id, r.text == "") for r in got) == [(4, True), (4, True), (5, False)]


def test_empty_table(spark):
    docs = documents(spark, [(1, "a")]).limit(0)
    assert near.near_duplicates(docs).count() == 0 and near.keep_one(docs).count() == 0
    assert near.near_duplicates(documents(spark, [(1, None), (2, "")])).count() == 2


def test_components_of_edges(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100} | {300 + i: 300 for i in range(30)}
