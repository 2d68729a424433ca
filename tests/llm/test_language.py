import random
import zlib

import pytest

from rackpulse.llm import language
from tests.llm.helpers import documents

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and the other thing was there with them " * 6,
           "de": "der schnelle braune fuchs springt über den faulen hund und das andere ding war bei ihnen " * 6}


def phrases_by_hand(text, sample, segment=language.SEGMENT):
    """Longest matches of the plain text in the sample, segment by segment."""
    plain, n = language.plain(text), 0
    for start in range(0, len(plain), segment):
        part, i = plain[start:start + segment], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
    return n


@pytest.fixture(scope="module")
def parser():
    return language.Parser(language.LanguageModel(SAMPLES))


def test_phrases_are_longest_matches(parser):
    texts = ["The dog was here", "über 12 Füchse!", "", "  ..", "zzz qqq 漢字", "the fox " * 200, "Der Hund\tund the dog"]
    got, count = parser.phrases(texts)
    assert count.tolist() == [len(language.plain(t)) for t in texts]
    for i, t in enumerate(texts):
        assert got[i].tolist() == [phrases_by_hand(t, SAMPLES[name]) for name in parser.model.names], t


def test_large_alphabets_are_told_apart(monkeypatch):
    """Two languages of words over the same 3,000 characters: only the characters' order tells."""
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    words = [["".join(rng.choice(letters) for _ in range(2)) for _ in range(2500)] for _ in range(2)]
    text = lambda own, n: " ".join(rng.choice(own) for _ in range(n))
    samples = {name: text(own, 12_000) for name, own in zip(("aa", "bb"), words, strict=True)}
    parser = language.Parser(language.LanguageModel(samples))
    tests = [(name, text(own, 10)) for name, own in zip(samples, words, strict=True) for _ in range(100)]
    got, _ = parser.predict([t for _, t in tests])
    assert sum(g == name for g, (name, _) in zip(got, tests, strict=True)) >= 196
    found, _ = parser.phrases([t for _, t in tests[:5]])
    assert found.tolist() == [[phrases_by_hand(t, samples[n]) for n in ("aa", "bb")] for _, t in tests[:5]]


def test_very_long_texts_and_ties(parser):
    long = ("the quick brown fox " * 30_000) + " der"
    names, scores = parser.predict([long, "the quick brown fox " * 5, long])
    assert names == ["en"] * 3 and scores[0] == scores[2]
    same = language.Parser(language.LanguageModel({n: SAMPLES["en"] for n in ("zz", "mm", "nn")}))
    assert same.predict(["the dog", "qqq"])[0] == ["mm", "mm"]  # equal evidence: the smallest name


def test_predictions(parser):
    names, scores = parser.predict(["the other dog", "der andere hund", "123 !?", ""])
    assert names == ["en", "de", "und", "und"] and scores[2:].tolist() == [0.0, 0.0] and min(scores[:2]) > 0.5


def test_texts_in_no_learned_language_are_rejected(spark):
    rng = random.Random(8)
    foreign = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60))
    rows = [(1, SAMPLES["en"]), (2, SAMPLES["de"]), (3, foreign), (4, "漢字" * 40), (5, "xqzt"), (6, "12 !"), (7, None), (8, foreign + SAMPLES["en"])]
    docs = documents(spark, rows)
    kept = language.in_a_language(docs, language.LanguageModel(SAMPLES))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 8}


def test_training_leaves_out_the_held_out_fold(spark):
    rows = [(i, SAMPLES["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(30)]
    rows += [(i, "xyzzy " * 50, "held") for i in range(30, 200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows += [(None, "plugh " * 50, "nobody"), (201, None, "en"), (202, "no label", None)]
    model = language.train(documents(spark, rows))
    assert model.names == ["de", "en"]
    found = language.with_language(documents(spark, rows), model)
    assert found.count() == len(rows) and "score" in found.columns and "__text" in found.columns
    got = {r.doc_id: r.lang_pred for r in found.select("doc_id", "lang_pred").collect()}
    assert got[0] == "de" and got[1] == "en" and got[201] == "und"


def test_no_training_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "text", None)])
    assert language.train(docs) is None
    assert [r.lang_pred for r in language.with_language(docs, None).collect()] == ["und"]
    assert language.with_language(docs.limit(0), None).count() == 0


def test_accuracy_on_held_out_documents(spark):
    from tests.conftest import SF01
    rows = language.op2_language(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet"), "doc_id")
    held = rows.where("held_out and lang is not null").selectExpr("avg(cast(lang = lang_pred as int)) a").first().a
    assert held > 0.95
