import random
import time

import numpy as np
import pytest

from rackpulse.llm import tokens
from tests.llm.helpers import documents, prose

ODD = ["", "a", "don't 's's ''s !'s 're've'll'l 'lx", "<|endoftext|>abc<|endoftext|><|startoftext|>!!<|endof",
       "hello!!!<|endoftext|>???", "   ", "x'd'd'dog it's", "A" * 70 + " " + "!" * 90 + "é" * 60, "漢字 12³ 😀😀 a\x00b",
       "é ΣΑΣ Straße", "it's\nthe\tend"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    with np.errstate(over="ignore"):
        yield tokens.PrefixCounter(tokens.vocabulary_path())


def test_whole_texts_and_all_prefixes_equal_the_library(counter, library):
    for text in ODD:
        got = next(iter(counter.prefix_counts([text]))).tolist()
        assert got[-1] == library([text])[0], text
        normal = "".join(p for p, _ in counter.pieces(text))
        if len(normal) == len(text):
            assert got == library([text[:k] for k in range(len(text) + 1)]), text


def test_random_texts(counter, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdehlmnrstu'! 1é<|>ßç\n") for _ in range(rng.randrange(80))) for _ in range(1500)]
    assert [int(c[-1]) for c in counter.prefix_counts(texts)] == library(texts)


LONG_WORDS = {"letters": "abcdefghijklmnopqrstuvwxyz", "dna": "acgt", "one": "a", "marks": "!?", "han": "漢字中国語学校日本人", "cyrillic": "абвгдежз"}


@pytest.mark.parametrize("letters", LONG_WORDS.values(), ids=LONG_WORDS)
def test_long_words(counter, library, letters):
    rng = random.Random(3)
    text = "".join(rng.choice(letters) for _ in range(40_000))
    began = time.time()
    assert int(next(iter(counter.prefix_counts([text])))[-1]) == library([text])[0]
    assert time.time() - began < 20
    part = text[:700]
    assert next(iter(counter.prefix_counts([part]))).tolist() == library([part[:k] for k in range(len(part) + 1)])


def test_letters_of_a_later_unicode_version(counter, library):
    texts = [t for c in map(chr, tokens.LATER_LETTERS) for t in (c, f"a{c}b", f"{c}!", f"!{c}1", f"1{c}{c} x")]
    assert [int(c[-1]) for c in counter.prefix_counts(texts)] == library(texts)


def test_chunks_and_forgetting_change_nothing(counter, library, monkeypatch):
    texts = [prose(i, 60) + " ünd thereof" for i in range(60)]
    monkeypatch.setattr(tokens, "CHUNK", 300)
    monkeypatch.setattr(tokens, "MAX_WORDS", 150)
    assert [int(c[-1]) for c in counter.prefix_counts(texts)] == library(texts)


def test_budgets(spark, library):
    long = prose(1, 3000)
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "one two three"), (None, "x")]
    got = {(r.doc_id, r.n_tokens): r for r in tokens.token_budgets(documents(spark, rows), limit=100).collect()}
    n = library([long])[0]
    assert set(got) == {(1, 0), (2, 0), (3, n), (4, library(["one two three"])[0]), (None, 1)}
    cut = got[3, n].fit_chars
    assert library([long[:cut]])[0] <= 100 < library([long[:cut + 1]])[0] and got[3, n].n_bytes == len(long)
    assert got[4, library(["one two three"])[0]].fit_chars == 13
    table = tokens.prefix_token_counts(documents(spark, [(4, "one two")])).first().prefix_tokens
    assert table == library(["one two"[:k] for k in range(8)])


def test_empty_table(spark):
    assert tokens.token_budgets(documents(spark, [(1, "a")]).limit(0)).count() == 0
