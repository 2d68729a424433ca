"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A document of a source whose target is ``r`` times its size is expected ``r`` times: ``floor(r)`` whole copies are certain,
one more is taken with inclusion probability ``p = r - floor(r)``. Documents are ranked by their random odds
``u / (1 - u)`` divided by the inclusion odds ``p / (1 - p)`` and taken in that order until the words left for the source
are used up, so the sample has a fixed size in words. The random number is a digest of document id and text: reruns agree.

The cut in the ranking is found by two rounds of sums over bins of the rank (at most 4096 a source and round) and a
window over the few documents of the last bin, so a source with a third of all rows is never sorted in one task.

Defined cases: null text has size 0 and is never cut (0 words either way); null source is a source of its own, weighed
last; rows that agree in id and text share one random number and are taken or left together; a source of size 0 has
target 0; an empty table gives an empty result. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import WORD, store

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MAX_REPEAT = 3
#: The random number has 52 bits; each round of bins reads 12 of them.
U_BITS, BIN_BITS = 52, 12
#: A source's rows meet its plan in so many parts, so that none lands in one task.
SALTS = 64


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u): words of the whole text and a 52-bit random number per document."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                            F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, U_BITS // 4), 16, 10).cast("long").alias("u"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): one row per source.

    ``sizes`` holds (source, words). Sharing out the excess again and again ends where every uncapped source has the same
    words per weight; sources are capped in the order of cap over weight, so that level follows from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_repeat).alias("cap"))
    fill = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     .alias("rest"),
                     (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("rest_w"),
                     F.row_number().over(fill).alias("place"))
    # the first source, in that order, that its share of the rest doesn't fill sets the level for itself and all after it
    per = per.withColumn("open", F.col("cap") * F.col("rest_w") > F.col("rest") * F.col("w"))
    level = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("open"), F.struct("place", "rest", "rest_w"))).over(level)
    share = first["rest"] * F.col("w") / first["rest_w"]
    return per.select("source", "source_size", F.when(first.isNull(), F.col("cap").cast("double"))
                      .otherwise(share).alias("target"))


def _bin(level: int) -> Column:
    """The bits of u that the round ``level`` (1, 2) looks at."""
    return F.shiftright("u", U_BITS - level * BIN_BITS).bitwiseAND(F.lit((1 << BIN_BITS) - 1))


def _rank_odds(plan_p: Column) -> Column:
    """Random odds over inclusion odds; rises with u in a source, where the inclusion odds are the same."""
    u = (F.col("u") + F.lit(0.5)) / F.lit(float(1 << U_BITS))
    return (u / (1 - u)) / (plan_p / (1 - plan_p))


def _crossing(sums: DataFrame, quota: DataFrame, level: int) -> DataFrame:
    """(source, bin{level}, left): the bin of each source in which its quota is reached, and what is left for that bin."""
    order = Window.partitionBy("source").orderBy(f"bin{level}")
    run = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = (sums.withColumn("run", run).join(quota, sums["source"].eqNullSafe(quota["s"]))
             .where((F.col("run") > F.col("quota")) & (F.col("run") - F.col("words") <= F.col("quota"))))
    return found.select(F.col("s"), F.col(f"bin{level}").alias(f"at{level}"),
                        (F.col("quota") - F.col("run") + F.col("words")).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Every document with its source's target and the copies the mix takes of it.

    Returns doc_id, source, size, source_size, target (of the source, in words), copies, taken (= copies * size).
    """
    sized = store(document_sizes(docs).withColumns({"bin1": _bin(1), "bin2": _bin(2)}), "mix-sizes")
    # one pass sums the sources and the first bins
    sums1 = store(sized.groupBy("source", "bin1").agg(F.sum("size").alias("words")), "mix-bins")
    targets = source_targets(sums1.select("source", "words"), weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = store(targets.select("source", "source_size", "target", whole.cast("int").alias("whole"))
                 .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
                 .withColumn("p", F.when(F.col("source_size") > 0, F.col("quota") / F.col("source_size"))
                             .otherwise(0.0)), "mix-plan")
    quota = plan.where("p > 0").select(F.col("source").alias("s"), "quota")
    at1 = _crossing(sums1, quota, 1)
    near = sized.join(at1, sized["source"].eqNullSafe(at1["s"]) & (sized["bin1"] == at1["at1"]))
    at2 = _crossing(near.groupBy("source", "bin2").agg(F.sum("size").alias("words")),
                    at1.select("s", "quota"), 2)
    last = (near.select("source", "bin2", "u", "size").groupBy("source", "bin2", "u").agg(F.sum("size").alias("words"))
            .join(at2, F.col("source").eqNullSafe(at2["s"]) & (F.col("bin2") == F.col("at2")))
            .select("source", "u", "words", "quota"))
    # in the last bin by the Pareto rank itself; the document that crosses the quota goes in if that comes nearer
    rank = last.join(plan.select(F.col("source").alias("s"), "p"), F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "odds", _rank_odds(F.col("p")))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("odds", "u")
                              .rowsBetween(Window.unboundedPreceding, 0))
    cut = (rank.withColumn("run", run)
           .groupBy("source").agg(
               F.max(F.when(F.col("run") - F.col("words") / 2 <= F.col("quota"), F.col("u"))).alias("in_last"),
               F.min(F.shiftright("u", U_BITS - 2 * BIN_BITS)).alias("bin12"))
           .select(F.col("source").alias("s"), F.coalesce(
               "in_last", F.shiftleft("bin12", U_BITS - 2 * BIN_BITS) - 1).alias("cut")))
    plan = plan.join(cut, plan["source"].eqNullSafe(cut["s"]), "left").drop("s").withColumnRenamed("source", "s")
    more = F.when(F.col("p") <= 0, False).when(F.col("cut").isNull(), True).otherwise(F.col("u") <= F.col("cut"))
    copies = F.col("whole") + more.cast("int")
    plan = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = sized.withColumn("salt", F.pmod("u", F.lit(SALTS)).cast("int"))
    return (sized.join(plan, sized["source"].eqNullSafe(plan["s"]) & (sized["salt"] == plan["part"]))
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def op7_mixing(spark, sf_dir) -> DataFrame:
    from rackpulse.llm.common import table
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "copies", "taken")


#: The same by windows over whole sources.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS u
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM per),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_w
  FROM weighed),
level AS (SELECT * FROM filled WHERE cap * rest_w > rest * w ORDER BY place LIMIT 1),
plan AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.place IS NULL OR f.place < l.place THEN f.cap::DOUBLE
              ELSE (l.rest * f.w)::DOUBLE / l.rest_w::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON true),
quota AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS whole FROM plan),
ranked AS (
  SELECT s.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS left_over,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         sum(s.size) OVER (PARTITION BY s.source, s.u) AS own
  FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN left_over > 0 AND run - own / 2 <= left_over THEN 1 ELSE 0 END)::INT AS copies,
       ((whole + CASE WHEN left_over > 0 AND run - own / 2 <= left_over THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked
"""
