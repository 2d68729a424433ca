from collections import defaultdict

from rackpulse.llm import mixing
from tests.llm.helpers import documents, prose


def water_fill(sizes, weights=(5, 2, 1), times=3):
    """Targets by sharing out the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), list(order), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        for s in open_:
            target[s] += share * w[s]
        left = sum(max(0.0, target[s] - times * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], times * sizes[s])
        open_ = [s for s in open_ if target[s] < times * sizes[s]]
    return target


def check(rows, docs):
    taken, sizes = defaultdict(int), defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = water_fill(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
    return taken, sizes, want


def test_targets_and_taken_words(spark):
    rows = [(i, prose(i, 5 + i % 50), None, f"s{i % 7}") for i in range(700)] + [(i, prose(i, 30), None, None) for i in range(700, 720)]
    rows += [(900 + i, prose(i, 40), None, "s0") for i in range(400)]   # a hot source
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    taken, sizes, want = check(got, docs)
    assert all(abs(taken[s] - want[s]) <= 55 for s in sizes)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "one two", None, "b"), (3, "one two", None, "b"),
            (None, "x y z", None, None), (5, prose(1, 40000), None, "c"), (6, "   ", None, "d")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    check(got, docs)
    assert len(got) == 7 and {r.size for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.copies for r in got if r.doc_id == 3}) == 1
    assert {r.target for r in got if r.source == "a"} == {0.0}
    assert [r.size for r in got if r.doc_id == 6] == [2]   # other white space is a word


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [(1, "a")]).limit(0)).count() == 0
