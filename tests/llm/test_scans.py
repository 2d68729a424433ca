"""License scans, decontamination, top-k search and WARC: odd rows and plain versions."""

import gzip
import json
import math
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from rackpulse.llm import decontam, licenses, topk, warc
from rackpulse.llm.common import new_path
from tests.llm.helpers import documents, lower_az, prose, shingles

LICENSE_ROWS = [
    (1, None), (2, ""), (3, "CC BY cc-by\ncc  by all rights reserved"), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "under the License, Version 2.0, licensed\nby Apache the"), (6, "General\nPublic License general public license"),
    (7, "This work is licensed under the GNU General Public License, version 3"), (8, "cK ccK by"), (9, "ccby cc bye"),
    (10, prose(1, 30000) + "\nReleased under the MIT License."), (4, "Licensed under the Apache License, Version 2.0."),
    (11, "released under the license"), (12, "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
          "software and associated docs files"), (None, "all rights reserved"), (13, "é cc by ß\x00cc by"),
]


def scan_by_hand(text):
    low = lower_az(text or "")
    w = re.findall(licenses.WORD, low)
    places, labels, best = defaultdict(list), set(), 0.0
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places[label] = [i for i in range(len(w)) if w[i:i + len(p)] == p]
    for line in re.split("[\n\r]", low):
        b = set(re.findall(licenses.WORD, line))
        for label, notice in licenses.TEMPLATES:
            t = set(re.findall(licenses.WORD, notice.lower()))
            if len(b & t) >= math.ceil(licenses.CONTAINMENT * len(t) - 1e-9):
                labels.add(label)
                best = max(best, len(b & t) / len(t))
    every = [i for v in places.values() for i in v]
    base = {k for k, v in places.items() if v}
    return (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if every else best)


def test_license_scan_equals_a_plain_scan(spark):
    got = licenses.scan(documents(spark, LICENSE_ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *scan_by_hand(t)) for i, t in LICENSE_ROWS), key=repr)
    assert scan_by_hand(LICENSE_ROWS[10][1])[5] == "apache-2.0" and licenses.scan(documents(spark, LICENSE_ROWS).limit(0)).count() == 0


def in_order(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        last = row
    return last[-1]


def wrapped_by_hand(text):
    """Labels and best score with the windows of words that the line ends have no part in."""
    *_, base, labels, score = scan_by_hand(text)
    w, labels = re.findall(licenses.WORD, lower_az(text or "")), set(labels.split(",")) - {""}
    for label, notice in licenses.TEMPLATES:
        n = re.findall(licenses.WORD, notice.lower())
        t = set(n)
        most = sorted((n.count(x) for x in t), reverse=True)[:len(t) - math.ceil(licenses.CONTAINMENT * len(t) - 1e-9)]
        for i in range(len(w)):
            b = w[i:i + licenses.REACH * len(n)]
            if len(t & set(b)) >= math.ceil(licenses.CONTAINMENT * len(t) - 1e-9) and in_order(b, n) >= len(n) - sum(most):
                labels.add(label)
                score = max(score, len(t & set(b)) / len(t))
    return base, ",".join(sorted(labels)), score


def wrap(text, words, mark="\n"):
    w = text.split(" ")
    return mark.join(" ".join(w[i:i + words]) for i in range(0, len(w), words))


def test_license_scan_finds_wrapped_notices(spark):
    rows, want = [], {}
    for label, notice in licenses.TEMPLATES:
        for mark in ("\n", "\r\n * ", "\n\n# "):
            for words in (1, 3, 7, 11):
                want[len(rows)] = label
                rows.append((len(rows), f"{prose(len(rows), 40)}\n{wrap(notice, words, mark)} {prose(1, 40)}"))
    odd = len(rows)
    bsd, mit = licenses.TEMPLATES[11][1], licenses.TEMPLATES[3][1]
    rows += [(odd + i, t) for i, t in enumerate((
        wrap(mit.replace("copy", "replica"), 8), wrap(mit.replace("copy", "replica").replace("files", "data"), 8),
        wrap(" ".join(reversed(bsd.split(" "))), 6), wrap(" w ".join(bsd.split(" ")), 6), wrap(" w w ".join(bsd.split(" ")), 6),
        wrap(licenses.TEMPLATES[5][1].replace(" the ", " a "), 9), f"{prose(3, 50)} {bsd} {prose(4, 50)}",
        prose(5, 5000) + "\n" + wrap(bsd, 8) + "\n" + prose(6, 5000), bsd + "\n" + wrap(mit, 9), "the\nlicense", "a\n\n"))]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in want.items())
    hand = {i: wrapped_by_hand(t) for i, t in rows}
    assert {i: (r.base_labels, r.labels) for i, r in got.items()} == {i: h[:2] for i, h in hand.items()}
    assert all(abs(got[i].score - h[2]) < 1e-12 for i, h in hand.items())
    assert [got[odd + i].labels for i in range(9)] == ["mit", "", "", "bsd", "", "gpl", "bsd", "bsd", "bsd,mit"]


def test_decontamination_equals_all_pairs(spark):
    items = [(1, prose(1, 40, 5000)), (2, prose(2, 8, 5000)), (3, "too short"), (4, None), (5, ""), (1, prose(1, 40, 5000)),
             (1, prose(6, 33, 5000)), (None, prose(8, 20, 5000)), (9, prose(9, 5, 5000))]
    inside = lambda t, seed: f"{prose(seed, 300, 5000)} {t} {prose(seed + 1, 300, 5000)}"
    cut = items[0][1].split()
    rows = [(10, inside(items[0][1], 20)), (11, inside(items[1][1], 22)), (12, items[0][1]), (13, inside(" ".join(cut[:36]), 24)),
            (14, inside(" ".join(cut[:30]), 26)), (15, "Too  SHORT"), (16, None), (17, ""), (18, prose(30, 20000, 5000) + items[7][1]),
            (10, inside(items[0][1], 20)), (None, inside(items[8][1], 28)), (19, inside(items[6][1].upper(), 31)),
            (20, " ".join(reversed(cut)))]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, n int")
    want = set()
    for d, t in set(rows):
        for i, q in set(items):
            s = shingles((q or "").lower())
            both = len(s & shingles((t or "").lower()))
            if s and both >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(s), both))
    got = [tuple(r) for r in decontam.contaminated(docs, bench).select("doc_id", "item_id", "n_item", "n_shared").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 7
    clean = decontam.decontaminate(docs, bench)
    bad = {d for d, *_ in want}
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _ in rows if d not in bad), key=repr)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 == decontam.contaminated(docs, bench.limit(0)).count()
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_short_items_are_found_inside_long_documents(spark):
    items = [(1, "Zebra"), (2, "pink Zebra"), (3, "one two three four"), (4, "zebra crossing ahead"), (5, prose(3, 30))]
    rows = [(1, f"{prose(4, 200)} zebra {prose(5, 200)}"), (2, f"{prose(6, 50)} a PINK  zebra"), (3, "two three four one two three"),
            (4, f"one two three\nfour {prose(7, 40)}"), (5, "pink"), (6, "zebra"), (7, "pink zebra crossing ahead"), (8, prose(3, 30)),
            (9, f"{prose(8, 9)} zebra-pink zebras"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.contaminated(documents(spark, rows), bench).collect()}
    want = set()
    for d, t in rows:
        w = lower_az(t or "").split()
        for i, q in items:
            p = lower_az(q).split()
            if len(p) < 5 and any(w[j:j + len(p)] == p for j in range(len(w) - len(p) + 1)):
                want.add((d, i, 1, 1))
    assert got == want | {(8, 5, 26, 26)} and len(want) == 8
    import duckdb
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.executemany("insert into benchmark values (?, ?)", items)
    assert {tuple(r[:4]) for r in con.execute(decontam.ORACLE_SQL).fetchall()} == got


def best_by_hand(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_top_k_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 24).round(3).tolist()) for i in range(700)]
    rows += [(700, None), (720, [None] * 24), (740, [float("nan")] * 24), (760, [float("inf")] * 24), (780, []), (800, [0.5, 0.25]),
             (801, [0.5, 0.25]), (None, rows[0][1]), (820, [0.0] * 24)] + [(900 + i, rows[40][1]) for i in range(30)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = topk.top_k(df.where("vec_id % 20 = 0"), df).collect()
    assert sorted(map(tuple, got)) == best_by_hand(rows)
    assert topk.top_k(df.limit(0), df).count() == 0


def test_top_k_large_numbers_stay_exact(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [-1e7, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id = 0"), df).collect()
    want = [x for x in best_by_hand(rows) if x[0] == 0]
    assert sorted(map(tuple, got)) == want and want[0][3] > 1 << 53
    far = spark.createDataFrame([(0, [1e12]), (2, [1e11]), (1, [1e12]), (3, [-1e12])], "vec_id long, embedding array<double>")
    got = topk.top_k(far.where("vec_id = 0"), far).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1), (0, 3, 3, -(1 << 63))]


@pytest.mark.parametrize("size", [2.0 ** 28, 2.0 ** 30, 2.0 ** 34])
def test_top_k_with_one_large_component(spark, size):
    """Candidates of which one component is near 2^34 to 2^40 once scaled, all others small, so that the small ones decide."""
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (900, 32)) / 64.0
    v[:, 7] = size + rng.integers(0, 3, 900) / 64.0
    v[::20, 7] = 0.0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id % 20 = 0 and vec_id < 200"), df).collect()
    assert sorted(map(tuple, got)) == [x for x in best_by_hand(rows) if x[0] < 200]


@pytest.mark.parametrize("dims, n, k", [(1, 30, 20), (9, 21, 20), (64, 20, 20), (64, 900, 20), (130, 300, 3)])
@pytest.mark.parametrize("tile, few", [(2, 1000), (64, 16), (64, 1)])
def test_tiles_of_queries_change_nothing(monkeypatch, dims, n, k, tile, few):
    """Queries with their mass in different blocks; all stay in the tile, some leave it, all leave it after the first block."""
    monkeypatch.setattr(topk, "QUERY_TILE", tile)
    monkeypatch.setattr(topk, "FEW", few)
    rng = np.random.default_rng(dims + n)
    v = np.floor(rng.normal(0, 9, (n, dims)) * rng.choice([0, 1, 20], (n, -(-dims // 8))).repeat(8, 1)[:, :dims])
    rows = list(enumerate(v.tolist()))
    got = [(q, r, i, s) for q, ids, scores in topk.search_block(v[::20], np.arange(n)[::20], np.ascontiguousarray(v.T), np.arange(n), k)
           for r, (i, s) in enumerate(zip(ids.tolist(), scores.tolist(), strict=True), 1)]
    want = best_by_hand([(i, (np.array(x) / 64).tolist()) for i, x in rows], k)
    assert sorted((20 * q, r, i, s) for q, r, i, s in got) == want


def test_top_k_of_random_directions_costs_little_more_than_their_products():
    """No order of dimensions helps here: a query costs about twice its plain products (10 times when queries went one by one).
    Both run in this thread: einsum has no threads of its own, unlike a product by BLAS."""
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (8192, 64))
    v = np.floor(64 * v / np.linalg.norm(v, axis=1, keepdims=True))
    columns, ids = np.ascontiguousarray(v.T), np.arange(len(v))

    def seconds(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    plain = min(seconds(lambda: [np.argpartition(-np.einsum("i,ij->j", q, columns), 20) for q in v[:256]]) for _ in range(3))
    search = min(seconds(lambda: list(topk.search_block(v[:256], ids[:256], columns, ids, 20))) for _ in range(3))
    assert search < 5 * plain


def test_top_k_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [2.0, 0.0]), (1, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df.where("vec_id = 0"), df).collect())
    want = []
    for at, (q, a) in enumerate(rows[:3]):
        found = sorted((-64 * 64 * int(a[0] * b[0] * 2) // 2, i) for j, (i, b) in enumerate(rows) if j != at)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)


PAGES = [(1, "http://a", "x" * 100), (2, "http://b", "x" * 100), (3, "http://c", "x" * 99), (4, "http://d", "x" * 99), (5, None, None),
         (6, "http://e\r\nEvil: 1", "é" * 60 + "\r\n\r\nWARC/1.1"), (7, "u", "y" * 3_000_000), (8, "u", "y" * 3_000_000), (2, "http://b", "x" * 100),
         (None, "n", "x" * 100), (9, "u", ""), (10, "u", "\x00\r\n\r\n" * 50), (11, "z", "z" * 200), (11, "z", "z" * 200)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, record_type string, offset int")
    folder = new_path(spark, "warc-test")
    got = sorted((tuple(r) for r in warc.round_trip(pages, folder, archive_bytes=4000).collect()), key=repr)
    import hashlib
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [j for j, _, h in PAGES if j is not None and (h or "").encode() == data]
        first = min(same) if same and len(data) >= 100 else None
        later = first is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first if later else None))
    assert got == sorted(want, key=repr)
    import glob
    path = folder.replace("file:", "")
    files = glob.glob(f"{path}/*.warc.gz")
    members = [f for f in files if ".mono." not in f]
    assert len(members) * 2 == len(files) > 2
    for f in members:   # each entry is a gzip member of its own, and together they are the monolithic contents
        data = open(f, "rb").read()
        index = [json.loads(x) for x in open(f.removesuffix(".gz") + ".idx")]
        parts = [gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in index]
        assert b"".join(parts) == gzip.open(f.replace(".warc.gz", ".mono.warc.gz")).read()
        assert all(p.startswith(b"WARC/1.1\r\n") for p in parts) and sum(e["length"] for e in index) == len(data)
        assert not any(b"\r\nEvil: 1" in p.split(b"\r\n\r\n")[0] for p in parts)


def test_warc_empty_table_and_broken_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    whole = gzip.compress(warc._record({"page_id": 1, "url": None, "payload": b"p" * 500, "payload_bytes": 500, "payload_digest": "d",
                                        "record_type": "response", "refers_to": None}))
    (tmp_path / "a.mono.warc.gz").write_bytes(whole[:-30])
    with pytest.raises(ValueError):
        warc.normalise_file(str(tmp_path), "a.mono.warc.gz")
