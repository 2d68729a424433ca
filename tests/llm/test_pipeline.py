import math

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rackpulse.llm import decontam, language, near, quality, registry
from tests.conftest import SF001
from tests.llm.helpers import components, counted, shingles

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language identification", "near duplicates",
                                                      "benchmark decontamination", "source mixture"]
    assert len(registry.QUERIES) == 14 and set(registry.ORACLE_SQL) < set(registry.QUERIES)


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        got = {r.doc_id for r in out.collect()}
        if name == "quality classifier":
            net = quality.train(spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet"))
            want = {i for i, t in rows.items() if net.scores([(t or "").encode()])[0] >= quality.THRESHOLD - 1e-6}
            assert got <= want and len(want) - len(got) <= 1
        elif name == "language identification":
            parser = language.Parser(language.train(spark.read.parquet(f"{SF001}/documents.parquet")))
            foreign = {i for i, t in rows.items() if parser.measure([t or ""])[2][0] > language.MOST_BITS}
            assert got == {i for i, t in rows.items() if language.plain(t or "")} - foreign
        elif name == "near duplicates":
            ids = sorted(rows)
            found = components([rows[i] for i in ids])
            assert got == {i for k, i in enumerate(ids) if found[k][1] == k}
        else:
            items = [shingles(r.text.lower()) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
            bad = {i for i, t in rows.items() if any(
                len(q & shingles((t or "").lower())) >= decontam.CONTAINMENT * len(q) for q in items)}
            assert got == set(rows) - bad
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert mixed.count() == docs.count()
    assert counted(corpus_pipeline.run(spark, SF001).collect()) == counted(mixed.collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF001)
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    same = lambda r: tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)
    assert counted(map(same, df.collect())) == counted(same([r[i] for i in at]) for r in cur.fetchall())


def test_odd_documents_go_through_all_stages(spark):
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "src0", 0), (None, "words without id", None, None, 3)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.where("doc_id >= 900001").count() == 0   # without letters
    empty = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF001).count() == 0


def test_repeated_rows_ties_and_clashing_columns_go_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    one = docs.where("lang = 'en' and length(text) between 600 and 3000").orderBy("doc_id").limit(3)
    foreign = spark.createDataFrame([(900009, "qxzvkj wqpfxz " * 30, "en", "src0", 420)], docs.schema)
    more = docs.unionByName(one).unionByName(one.selectExpr("doc_id + 800000 doc_id", "text", "lang", "source", "n_chars")).unionByName(foreign)
    for clash in ("score", "quality_score", "predicted_language", "language_bits", "root", "n", "h", "item_id"):
        more = more.withColumn(clash, F.lit(clash))
    columns, kept = more.columns, more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF001)
        assert kept.columns == columns, name
        if name == "language identification":
            assert kept.where("doc_id = 900009").isEmpty()
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and not any(800000 <= i < 900000 for i in ids) and len(ids) > 50
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF001).count() == len(ids)


def test_near_module_keeps_documents_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(5)
    assert near.keep_one(docs).schema == docs.schema
