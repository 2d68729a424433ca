import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rackpulse.llm import suffixes
from tests.llm.helpers import counted, documents, prose


def plain(texts, span=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if t else 0,
                    hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(4)
    passage, line = prose(1, 60, 5000), prose(2, 41, 5000)
    texts = [prose(100 + i, 80, 5000) for i in range(40)]
    for i in range(0, 40, 3):  # passages at many places, cut at many lengths
        at = rng.randrange(len(texts[i]))
        a, b = sorted(rng.sample(range(len(passage)), 2))
        texts[i] = texts[i][:at] + passage[a:b] + texts[i][at:]
    texts += [texts[1]] * 3 + [texts[2][:300] + "x" + texts[2][301:], texts[2][5:], texts[4][:199], texts[4][:200], texts[5][-201:]]
    texts += [prose(200 + i, 9, 5000) + line + prose(300 + i, 9, 5000) for i in range(12)]
    texts += ["a" * 150, "b" * 200, "c" * 201, "d" * 900, "ab" * 150, "e" * 200 + "E" + "e" * 199, "éü" * 140, None, "", "short"]
    texts += [passage + "-" + passage, "0123456789" * 60]
    return texts


@pytest.mark.parametrize("block", [suffixes.BLOCK, 2])
def test_equals_plain_version(spark, monkeypatch, block):
    texts = cases()
    rows = [(i if i % 9 else None if i % 2 else 7, t) for i, t in enumerate(texts)]
    cut = suffixes.without_repeats(documents(spark, rows), block=block)
    got = [(r.doc_id, len((r.text or "").encode()), sum(x.end - x.start for x in r.removed), len(r.removed),
            hashlib.sha256(bytes(r.kept)).hexdigest()) for r in cut.collect()]
    assert counted(got) == counted((r[0], *p) for r, p in zip(rows, plain(texts), strict=True))
    assert cut.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "score", "n", "__text"]


def test_very_long_texts_are_anchored_in_pieces():
    text = prose(9, 3000, 900).encode()
    text += text[500:1500]
    hashes = suffixes.PrefixHashes()
    found = {}
    for piece in (1 << 20, 700):
        windows = {}
        for _, k, _, lo, hi, at in suffixes.segments([text, b"x" * 500], hashes, piece=piece):
            for key, a, b, c in zip(k.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
                for s in range(a, b + 1):
                    windows.setdefault((s, key, c), 0)
        found[piece] = windows
    assert found[700] == found[1 << 20]
    assert len(found[700]) >= len(text) - 199


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "z" * 400, "a", 1), (2, None, "b", 2)], "doc_id int, text string, kept string, lo int")
    cut = suffixes.without_repeats(rows)
    assert cut.columns == ["doc_id", "text", "kept", "lo", "removed", "kept_"]
    assert {(r.doc_id, r.kept, bytes(r.kept_), len(r.removed)) for r in cut.collect()} == {(1, "a", b"", 1), (2, "b", b"", 0)}
    assert suffixes.without_repeats(rows.limit(0)).collect() == []


def test_suffix_sort_is_lexicographic_within_groups():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    texts += [b"aaaa", b"aaaa", b"aaa", b"aaaab"]
    group = np.sort(np.array([rng.randrange(6) for _ in texts]))
    size = np.array([len(t) for t in texts])
    made = suffixes.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.minimum(size, 40), group)
    want = sorted(range(len(texts)), key=lambda i: (group[i], texts[i][:40], i))
    assert made.order.tolist() == want
    for i in range(len(texts) - 1):
        a, b = texts[want[i]][:40], texts[want[i + 1]][:40]
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert made.common[i] == (same if group[want[i]] == group[want[i + 1]] else 0)


def test_wrong_hashes_are_noticed(monkeypatch):
    """With hashes that take all letters for equal the bytes tell, and the sort is done again with others."""
    real, made = suffixes.PrefixHashes.__init__, []

    def weak(self, seed=12):
        real(self, seed)
        made.append(seed)
        if seed == 1:
            self.letters[:] = 1
    monkeypatch.setattr(suffixes.PrefixHashes, "__init__", weak)
    texts = [b"banana", b"bandit", b"apples"]
    out = suffixes.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 6, 12]), np.array([6, 6, 6]), np.zeros(3))
    assert out.order.tolist() == [2, 0, 1] and made == [1, 2]
