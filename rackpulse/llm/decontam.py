"""Benchmark decontamination: which test items stand inside which documents (DataFrame functions only).

Size-partitioned MinHash containment search. Items are put into partitions by the size of their shingle set (powers of
two). An item of q shingles that is contained to the share t misses at most ``q - ceil(t * q)`` of them, so of any
``q - ceil(t * q) + 1`` one at least is in the document: each partition's MinHash sketch keeps that many of an item's
smallest hashes, taken at the partition's upper size bound. A document meets an item when it holds a hash of its sketch and
is large enough for it; no true pair is lost. Candidates are then verified by the exact containment of the shingles
themselves, over the whole document.

Words are runs without ASCII white space of the lower-cased text, shingles are five words; a text of fewer words is one
shingle as a whole. Where items of one to four words occur, documents also give their runs of so many words (of those sizes that
occur, no others), so a short item is found wherever its words stand one after another.

Defined cases: texts that are null, empty or white space have no shingles and are in no pair; item rows that repeat id and
text count once, rows that share only the id are items of their own; document rows that repeat id and text give their pairs
once; null ids stay null; an empty table on either side gives an empty result; columns other than doc_id, text and
item_id are ignored (and kept, by ``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import let, store, table

K = 5
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _windows(text: Column, made, sizes: Sequence[int], k: int = K) -> Column:
    """Distinct values of ``made(word, next word, ...)`` over the runs of k words; fewer words make one, none no value. Beside
    them ``made(run)`` of the runs of each of ``sizes`` words."""
    return let(words(text), lambda w: _of_words(w, made, sizes, k))


def _of_words(w: Column, made, sizes: Sequence[int], k: int) -> Column:
    def runs(n, value):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))),
                           lambda x, i: value(x, *[F.get(w, i + j) for j in range(1, n)]))

    each = runs(k, made)
    few = F.when(F.size(w) > 0, F.array(made(F.array_join(w, " ")))).otherwise(F.filter(each, lambda x: F.lit(False)))
    whole = F.when(F.size(w) >= k, each).otherwise(few)
    return F.array_distinct(F.concat(whole, *[runs(n, lambda *x: made(F.concat_ws(" ", *x))) for n in sizes]) if sizes else whole)


def shingle_hashes(text: Column, sizes: Sequence[int] = ()) -> Column:
    return _windows(text, F.xxhash64, sizes)


def shingle_texts(text: Column, sizes: Sequence[int] = ()) -> Column:
    return _windows(text, lambda *x: F.concat_ws(" ", *x), sizes)


def short_sizes(items: DataFrame) -> list[int]:
    """The numbers of words below a shingle's that items have: four at most."""
    n = items.select(F.size(words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < K)).distinct()
    return sorted(r.n for r in n.collect())


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, item_key, item_hashes, q, least, h): a row per hash of each item's sketch."""
    base = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"),
                        F.sort_array(shingle_hashes(F.col("text"))).alias("item_hashes")).distinct()
    base = base.withColumn("q", F.size("item_hashes")).where("q > 0")
    upper = F.pow(F.lit(2), F.ceil(F.log2("q"))).cast("int")  # the largest size of the item's partition
    needed = upper - F.ceil(upper * containment - 1e-9).cast("int") + 1
    return base.select("item_id", "item_key", "q", F.ceil(F.col("q") * containment - 1e-9).cast("int").alias("least"),
                       F.explode(F.slice("item_hashes", F.lit(1), needed)).alias("h"))


def candidates(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, sizes: Sequence[int] = ()) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key): documents that hold a hash of an item's sketch and are large enough."""
    sketch = item_sketches(items, containment)
    held = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"),
                       shingle_hashes(F.col("text"), sizes).alias("hashes"))
    held = held.select("doc_id", "doc_key", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    return (held.join(sketch, "h").where(F.col("n") >= F.col("least"))
            .select("doc_id", "doc_key", "item_id", "item_key").distinct())


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, doc_key, item_id, n_item, n_shared, containment) of every pair at or above ``containment``."""
    sizes = short_sizes(items)
    pairs = store(candidates(docs, items, containment, sizes), "leak-candidates")
    met = store(pairs.select("doc_id", "doc_key").distinct(), "leak-documents")
    d = met.select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key"))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    whole = (keyed.join(d, (F.col("doc_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
             .dropDuplicates(["doc_id", "doc_key"])
             .select("doc_key", "doc_id", shingle_texts(F.col("text"), sizes).alias("shingles")))
    own = items.select(F.xxhash64("item_id", "text").alias("item_key"),
                       shingle_texts(F.col("text")).alias("item_shingles")).dropDuplicates(["item_key"])
    p = pairs.select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), "item_id", "item_key")
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    return (p.join(whole, (F.col("doc_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
            .join(own, "item_key")
            .select("doc_id", "doc_key", "item_id", F.size("item_shingles").cast("long").alias("n_item"),
                    shared.cast("long").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("n_shared") >= F.col("n_item") * F.lit(containment) - 1e-9))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents, all columns, in which no item is contained."""
    bad = store(contaminated(docs, items, containment).select(F.col("doc_id").alias("__id"),
                                                              F.col("doc_key").alias("__key")).distinct(), "leaks")
    return docs.join(bad, (F.xxhash64(docs["doc_id"], docs["text"]) == bad["__key"])
                     & docs["doc_id"].eqNullSafe(bad["__id"]), "left_anti")


def op10_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_item", "n_shared", "containment")


def words_sql(source: str, key: str) -> str:
    """DuckDB: (key, w), the words of ``source``, a table of (key, text)."""
    return f"""SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'),
                                         lambda x: x <> '') AS w FROM {source}"""


def runs_sql(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


def shingles_sql(source: str, key: str) -> str:
    """DuckDB: (key, s), the distinct shingles of ``source``, a table of (key, w)."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {K} THEN {runs_sql(K)}
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {source}"""


def short_runs_sql(source: str, key: str, items: str) -> str:
    """DuckDB: (key, s), the runs of so many words as an item of fewer than a shingle's has."""
    return " UNION ".join(f"""SELECT {key}, unnest({runs_sql(n)}) AS s FROM {source}
        WHERE len(w) >= {n} AND EXISTS (SELECT 1 FROM {items} i WHERE len(i.w) = {n})""" for n in range(1, K))


ORACLE_SQL = f"""
WITH dw AS ({words_sql('documents', 'doc_id')}), qw AS ({words_sql('benchmark', 'item_id')}),
d AS ({shingles_sql('dw', 'doc_id')} UNION {short_runs_sql('dw', 'doc_id', 'qw')}),
q AS ({shingles_sql('qw', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
