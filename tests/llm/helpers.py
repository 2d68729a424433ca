"""Small documents for the operators' tests, and plain versions of what they compute."""

import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n int, __text string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves. rows: (doc_id, text[, lang, source])."""
    full = [(*r, *([None] * (4 - len(r))))[:4] + (None if r[1] is None else len(r[1]), "x", 7, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n_words, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n_words))


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    out = [""]
    for c in lower_az(text or ""):
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def shingles(text, k=5):
    w = words(text)
    if len(w) < k:
        return {" ".join(w)} if w else set()
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(texts, percent=80):
    """Per text the set size and the smallest index that links lead to."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def counted(rows):
    return Counter(tuple(r) for r in rows)
