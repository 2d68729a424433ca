import math
import re
from collections import Counter

import numpy as np
import pytest

from rackpulse.llm import lexical
from tests.llm.helpers import counted, documents, lower_az, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(lower_az(text or ""))


def plain(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for at, ((doc, bag), size) in enumerate(zip(bags, sizes, strict=True)):
            m = 75 + (25 * size * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc, at))
        out += [(item, r + 1, f[2], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:k])]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "item_id long, text string, score string, rank int")


@pytest.mark.parametrize("postings", [lexical.POSTINGS, 300])
def test_equals_plain_version(spark, postings):
    docs = [(i, prose(i, 5 + i % 60, 150 + i % 400)) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(3, "w1 w2 W1"), (3, "w1 w2 W1"), (None, "w1 w2 w1"), (-4, "w1,w2;w1")]
    docs += [(2000, None), (2001, ""), (2002, " .,;"), (2003, "Ünï w5 Ünï"), (2004, " ".join(f"w{i % 500}" for i in range(30000)))]
    items = [(i, prose(i * 3, 12, 200)) for i in range(12)] + [(5, docs[7][1]), (5, docs[7][1]), (6, None), (7, ""), (8, "nowhere"),
                                                            (None, "w1 w1 w2"), (9, "Ünï ünï W5")]
    got = lexical.ranked(documents(spark, docs), items_of(spark, items), postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert counted(got.collect()) == counted(plain(docs, items))


def test_empty_tables(spark):
    some, none = documents(spark, [(1, "w1 w2")]), documents(spark, [])
    assert lexical.ranked(some, items_of(spark, [])).collect() == []
    assert lexical.ranked(none, items_of(spark, [(1, "w1")])).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 50)
    texts = [b"ab " * 100 + b"x" * 300 + b" tail", b"y" * 200, b"", b"one two"]
    owner, h = lexical.Terms().of(texts)
    assert np.bincount(owner, minlength=4).tolist() == [102, 1, 0, 2]
    monkeypatch.setattr(lexical, "PIECE", 1 << 20)
    assert np.array_equal(lexical.Terms().of(texts)[1], h)


def test_range_maxima():
    rng = np.random.default_rng(1)
    code, doc = np.divmod(np.sort(rng.choice(4000, 900, False)), 400)
    impact = rng.integers(1, 50, 900)
    block = lexical.Block(code, doc, impact, 10, 400)
    for _ in range(300):
        t = rng.integers(10)
        lo, hi = block.start[t], block.start[t + 1]
        a = rng.integers(lo, hi)
        b = rng.integers(a + 1, hi + 1)
        v, place = block.maxima(np.array([a]), np.array([b]))
        assert v[0] == block.impact[a:b].max() and place[0] == a + block.impact[a:b].argmax()


def test_search_leaves_most_intervals_closed():
    """Best-first search scores few of the documents where bounds are tight."""
    n = 20000
    rng = np.random.default_rng(2)
    impact = np.where(np.arange(n) % 997 == 0, 900, rng.integers(1, 40, n))
    block = lexical.Block(np.zeros(n, np.int64), np.arange(n), impact, 1, n)
    added = []
    real = lexical.Best.add
    lexical.Best.add = lambda self, item, *rest: (added.append(len(item)), real(self, item, *rest))[1]
    try:
        best = lexical.search(block, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64))
    finally:
        lexical.Best.add = real
    assert best.score.tolist() == [900] * 20 and best.doc.tolist() == [997 * i for i in range(20)]
    assert sum(added) < 200
