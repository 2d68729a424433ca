import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.llm import quality, toxicity
from rackpulse.llm.training import MAX_BYTES
from tests.conftest import SF01
from tests.llm.helpers import documents


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    a, b = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - a * (a + 1) / 2) / (a * b)


@pytest.fixture(scope="module")
def held(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")

    def of(query, column):
        rows = query(spark, SF01).where("held_out").join(labels, "doc_id").select("score", "predicted", column).collect()
        return np.array([r.score for r in rows]), np.array([r[column] for r in rows]), np.array([r.predicted for r in rows])
    return of


def test_quality_on_held_out_documents(held):
    score, label, predicted = held(quality.op4_quality, "quality")
    assert auc(score, label) > 0.95 and predicted[label == 1].mean() > 0.97


def test_toxicity_on_held_out_documents(held):
    score, label, predicted = held(toxicity.op5_toxicity, "toxic")
    assert auc(score, label) > 0.6 and predicted[label == 0].mean() < 0.05


def test_toxicity_in_every_language(spark):
    """Held-out documents of sf0.1: most toxic ones are found in each language, and hardly any other is."""
    from tests.conftest import SF01 as small
    sf = small.replace("sf0.01", "sf0.1")
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    rows = toxicity.op5_toxicity(spark, sf).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    found = {r.lang: (r.recall, r.n, r.alarms) for r in rows.groupBy("lang").agg({"*": "count"}).join(rows.groupBy("lang").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.sum("toxic").alias("n"),
        F.sum(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("alarms")), "lang").collect()}
    assert all(recall >= 0.55 for recall, _, _ in found.values()), found
    assert sum(recall * n for recall, n, _ in found.values()) >= 0.8 * sum(n for _, n, _ in found.values()), found
    assert sum(alarms for _, _, alarms in found.values()) <= 3, found


def test_risk_gradient_is_that_of_the_plain_risk():
    def loss(z):
        return 1 / (1 + np.exp(z))

    def parts(zu, zp, prior):
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    rng = np.random.default_rng(4)
    for shift, prior in ((0.0, 0.2), (-3.0, 0.4), (2.0, 0.9)):
        zu, zp = rng.normal(shift, 1, 7), rng.normal(1, 1, 5)
        a, b = parts(zu, zp, prior)

        def plain(zu, zp):
            positive, negative = parts(zu, zp, prior)
            return positive + negative if b >= 0 else -negative
        for which, got in enumerate(toxicity.risk_gradient(zu, zp, prior)):
            for i in range(len(got)):
                up, down = [zu.copy(), zp.copy()], [zu.copy(), zp.copy()]
                up[which][i] += 1e-6
                down[which][i] -= 1e-6
                assert abs((plain(*up) - plain(*down)) / 2e-6 - got[i]) < 1e-6
    assert parts(rng.normal(-3, 1, 7), rng.normal(1, 1, 5), 0.4)[1] < 0


def test_pu_learning_finds_what_unlabelled_texts_hide():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    plain = [" ".join(word() for _ in range(40)).encode() for _ in range(900)]
    bad = [t + b" zwixxle" for t in plain[:300]]
    model = toxicity.fit_pu(bad[:150], plain[300:] + bad[150:225], 75 / 675)
    assert (model.scores(bad[225:]) >= 0.5).mean() > 0.95 and (model.scores(plain[:225]) >= 0.5).mean() < 0.02


@pytest.mark.parametrize("prior", [0.001, 0.0001])
def test_pu_learning_keeps_rare_words_at_low_rates(prior):
    rng = np.random.default_rng(0)
    word = lambda letters: "".join(rng.choice(list(letters), 7))
    rare = [word("qrstuvwxyz") for _ in range(20)]   # each in a twentieth of the toxic texts
    plain = [" ".join(word("abcdefghij") for _ in range(40)).encode() for _ in range(8000)]
    bad = [t + b" " + rare[i % 20].encode() for i, t in enumerate(plain[7000:7600])]
    hidden = round(6000 * prior)
    model = toxicity.fit_pu(bad[:300], plain[:6000 - hidden] + bad[300:300 + hidden], prior)
    assert (model.scores(bad[320:]) >= 0.5).mean() > 0.6 and (model.scores(plain[6000:7000]) >= 0.5).mean() < 0.01


def test_network_chunks_equal_a_plain_version():
    net = quality.ByteNet(seed=1)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 5, 127, 128, 129, 256, 257, 1000)]
    p, half, size = net.p, quality.HALF, 2 * quality.HALF

    def plain(text):
        halves = -(-max(len(text), 1) // half)
        data = np.frombuffer(text.ljust(halves * half, b"\0") + b"\0" * quality.WIDTH, np.uint8)
        out = []
        for k in range(max(1, halves - 1)):
            at = range(k * half, min(k * half + size, halves * half - quality.WIDTH + 1))   # windows inside the padded text
            best = np.max([sum(p["filters"][w][data[i + w]] for w in range(quality.WIDTH)) for i in at], axis=0)
            out.append(np.maximum(np.maximum(best + p["bias"], 0) @ p["hidden"] + p["hidden_bias"], 0))
        z = np.concatenate([np.mean(out, 0), np.max(out, 0)]) @ p["out"] + p["out_bias"][0]
        return 1 / (1 + np.exp(-z))

    assert all(abs(net.scores([t])[0] - plain(t)) < 1e-4 for t in texts)
    together = net.scores(texts * 3)
    assert all(abs(s - plain(t)) < 1e-4 for s, t in zip(together, texts * 3, strict=True))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2, 9) for i in range(40)] + [(None, 0, 1, 9), (3, None, None, 9), (3, 1, 1, 9)],
                                   "doc_id long, quality int, toxic int, score int")
    rows = [(i, ("good plain words here " if i % 2 else "!!! ### $$$ ") * 20) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * (MAX_BYTES * 3)), (7, rows[7][1]), (None, "no id")]
    docs = documents(spark, rows)
    model = module.train(docs, labels)
    found = (module.with_scores if module is quality else module.with_toxicity)(docs, model, "score")
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and set(found.columns) == set(docs.columns)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert (module.with_scores if module is quality else module.with_toxicity)(docs.limit(0), model).count() == 0
    nothing = module.train(docs, labels.limit(0))
    again = (module.with_scores if module is quality else module.with_toxicity)(docs, nothing).collect()
    assert {r.score for r in again} == ({0.5} if module is quality else {0.0})


@pytest.mark.parametrize("module", [quality, toxicity])
def test_long_training_texts_are_learned_from(spark, module):
    """Labelled texts that are all longer than what is learned from of one text still make a model: its scores differ (before, all
    were the same for want of a training row), and the toxic words are found."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good plain words stand here " if i % 2 else "rough lines && tokens ## fall ") * 1000) for i in range(60)]
    docs = documents(spark, rows)
    model = module.train(docs, labels)
    found = (module.with_scores if module is quality else module.with_toxicity)(docs, model, "score").collect()
    scores = {k: [r.score for r in found if r.doc_id % 2 == k] for k in (0, 1)}
    assert not set(scores[0]) & set(scores[1])
    assert module is quality or min(scores[1]) > max(scores[0])
