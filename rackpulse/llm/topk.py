"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors.

Vectors become integers, ``floor(64 * x)`` per component. Candidates lie in blocks of bounded size in vertical layout (a row
per dimension), queries in blocks of bounded size; each pair of blocks is one task's work, and a query's best of all
blocks are merged. Inside a pair, queries take the dimensions in blocks, those with most of their mass first; queries that begin
with the same block take them together. After each block, a candidate's score can still grow by no more than the product of what is
left of both norms; candidates whose bound is under a query's bar, the k-th best of some exact scores, are dropped. Once few are left,
a query goes on alone, and its survivors are moved together.

Scores are exact: 64-bit floats while norms guarantee that all sums stay below 2^52, Python integers beyond that (held to
the range of a 64-bit integer, where they may tie).

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids;
vectors meet those of their own length only; a query's own row is left out (of several rows with its id and its vector one); equal scores go to
the smaller vec_id, rows that repeat an id are ranked as rows of their own; with fewer candidates than k all are ranked;
an empty table gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import store, table

TOP, QUERY_EVERY, SCALE = 20, 20, 64
#: Vectors of a block, dimensions that are added at a time.
CANDIDATE_BLOCK, QUERY_BLOCK, DIMS = 8192, 1024, 8
#: Blocks of queries that meet a block of candidates in one group.
QUERY_GROUP = 4
#: Queries that take a block of dimensions together; one leaves them once no more than 1 / FEW of the candidates are left. Its bar is
#: the k-th best of LIKELY * k exact scores.
QUERY_TILE, FEW, LIKELY = 64, 16, 4
_EXACT = float(1 << 52)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, dims, v): the vectors that take part, floor(64 * x) as doubles (integral)."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    usable = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(ok)
    # multiplied as doubles; a product beyond their range would not be finite, so it is held there
    big = F.lit(1.7e308)
    scaled = F.transform(x, lambda e: F.greatest(F.least(e * F.lit(float(SCALE)), big), -big))
    return usable.select("vec_id", F.size("embedding").alias("dims"), scaled.alias("v"))


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(dims, block, ids, columns): blocks of about ``size`` vectors of one length as two binary values."""
    counts = vectors.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    placed = vectors.join(counts, "dims").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        values = group.column("v").combine_chunks()
        matrix = np.floor(values.flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1))
        ids = group.column("vec_id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        return pa.table({"dims": group.column("dims").slice(0, 1), "block": group.column("block").slice(0, 1),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "columns": pa.array([np.ascontiguousarray(matrix[order].T).tobytes()], pa.binary())})

    return store(placed.select("dims", "block", "vec_id", "v").groupBy("dims", "block").applyInArrow(
        run, "dims int, block int, ids binary, columns binary"), name)


def search_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int
                 ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, best ids, their scores) per query. ``queries`` has a row per query, ``columns`` a row per dimension; ``ids``
    are sorted, so that the first of equal scores is the one with the smaller id."""
    peak = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(columns).max(initial=0), 1))
    if peak * len(columns) >= _EXACT:
        yield from _search_integers(queries, query_ids, columns, ids, k)
        return
    starts = list(range(0, len(columns), DIMS))
    mass = np.add.reduceat(columns * columns, starts)  # per block of dimensions and candidate
    q_mass = np.add.reduceat(queries * queries, starts, axis=1)
    first = q_mass.argmax(1)
    for block in np.unique(first).tolist():  # queries that begin with the same block go together
        alike = np.flatnonzero(first == block)
        for tile in np.array_split(alike, -(-len(alike) // QUERY_TILE)):
            yield from _search_tile(queries[tile], query_ids[tile], tile, q_mass[tile], columns, ids, mass, k)


def _search_tile(queries, query_ids, numbers, q_mass, columns, ids, mass, k):
    """``search_block`` for a few queries, whose common first block has most of the mass of each."""
    size, n, last = len(columns), len(ids), len(mass)
    share = (q_mass / np.maximum(q_mass.sum(1, keepdims=True), 1)).sum(0)
    share[q_mass[0].argmax()] = np.inf
    order = np.argsort(-share, kind="stable")
    at = [slice(b * DIMS, b * DIMS + DIMS) for b in order.tolist()]
    dims = np.concatenate([np.arange(size)[x] for x in at])
    # what is left of the norms after each block; rests are added up from the last block, never taken off a sum, so that a small one is exact
    left = np.zeros((last, n))
    np.cumsum(mass[order[:0:-1]], axis=0, out=left[1:])
    left = np.sqrt(left)[::-1]
    q_left = np.zeros((len(queries), last))
    np.cumsum(q_mass[:, order[:0:-1]], axis=1, out=q_left[:, 1:])
    q_left = np.sqrt(q_left)[:, ::-1] * (1 + 1e-9)  # the bound is rounded up by more than rounding can take off
    score, bar = np.zeros((len(queries), n)), np.full(len(queries), -np.inf)
    for i, (q, own) in enumerate(zip(queries, query_ids.tolist(), strict=True)):
        out = _own_row(q, own, columns, ids)
        if out is not None:
            score[i, out] = -np.inf
    done = 0  # dimensions
    for step, block in enumerate(at):
        score += queries[:, block] @ columns[block]
        done += len(columns[block])
        if n > k and step in (0, last // 2):
            bar = np.maximum(bar, _bars(queries, score, columns, dims[done:], k))
        bound = np.multiply.outer(q_left[:, step], left[step])
        bound += score
        keep = bound >= (bar - 1e-6)[:, None]
        leaves = np.count_nonzero(keep, axis=1) * FEW <= n
        if step == last - 1:
            leaves[:] = True
        for i in np.flatnonzero(leaves).tolist():
            alive = np.flatnonzero(keep[i])
            alive, found = _finish(queries[i], alive, score[i, alive], bar[i], step + 1, at, columns, left, q_left[i])
            some = found > -np.inf
            alive, found = alive[some], found[some]
            best = np.lexsort((alive, -found))[:k]
            if len(best):
                yield int(numbers[i]), ids[alive[best]], found[best].astype(np.int64)
        if leaves.all():
            return
        if leaves.any():
            queries, numbers, q_left, score, bar = (x[~leaves] for x in (queries, numbers, q_left, score, bar))


def _bars(queries, score, columns, rest, k):
    """Per query the k-th best of the exact scores of those candidates that look best so far; ``rest``: dimensions to come."""
    n = score.shape[1]
    likely = np.argpartition(score, n - min(n, LIKELY * k), axis=1)[:, -LIKELY * k:]
    exact = np.take_along_axis(score, likely, 1)
    for i, q in enumerate(queries):
        exact[i] += q[rest] @ columns[rest[:, None], likely[i]]
    return np.partition(exact, exact.shape[1] - k, axis=1)[:, -k]


def _finish(q, alive, score, bar, step, at, columns, left, q_left):
    """(alive, their scores): a query's survivors through the blocks from ``step`` on."""
    while step < len(at) and len(alive):
        score = score + q[at[step]] @ columns[at[step], alive]
        keep = score + left[step, alive] * q_left[step] >= bar - 1e-6
        alive, score = alive[keep], score[keep]
        step += 1
    return alive, score


def _own_row(q: np.ndarray, own: int, columns: np.ndarray, ids: np.ndarray) -> int | None:
    """The place of the query's own row among the candidates: the first with its id and its vector."""
    a, b = np.searchsorted(ids, [own, own + 1])
    same = np.flatnonzero((columns[:, a:b] == q[:, None]).all(0)) if b > a else ()
    return a + int(same[0]) if len(same) else None


def _search_integers(queries, query_ids, columns, ids, k):
    """The same without bounds for numbers that floats can't add exactly."""
    rows = [[int(x) for x in c] for c in columns.T]
    for number, (q, own) in enumerate(zip(queries, query_ids.tolist(), strict=True)):
        out = _own_row(q, own, columns, ids)
        q = [int(x) for x in q]
        scores = [(min(max(sum(a * b for a, b in zip(q, r, strict=True)), _LOW), _HIGH), i)
                  for at, (r, i) in enumerate(zip(rows, ids.tolist(), strict=True)) if at != out]
        best = sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
        if best:
            yield number, np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of largest inner product."""
    q = _packed(integer_vectors(queries), QUERY_BLOCK, "topk-queries").toDF("dims", "q_block", "q_ids", "q_columns")
    c = _packed(integer_vectors(candidates), CANDIDATE_BLOCK, "topk-candidates")
    # every block of queries meets every block of candidates of its length: a group holds a block of candidates and a few
    # of queries, and the groups are dealt out over a fixed number of partitions
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = c.groupBy("dims").agg((F.max("block") + 1).alias("blocks"))
    groups = q.groupBy("dims").agg((F.floor(F.max("q_block") / QUERY_GROUP) + 1).cast("int").alias("groups"))
    asked = q.join(numbers, "dims").select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                           F.floor(F.col("q_block") / QUERY_GROUP).cast("int").alias("q_group"), "q_block", "q_ids", "q_columns")
    given = c.join(groups, "dims").select("dims", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("q_group"),
                                          "ids", "columns")
    keys = ["dims", "block", "q_group"]

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = []
        for row in given.to_pylist():  # one: a block of candidates
            ids, columns = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["columns"]).reshape(row["dims"], -1)
            for block in asked.to_pylist():
                query_ids = np.frombuffer(block["q_ids"], np.int64)
                matrix = np.ascontiguousarray(np.frombuffer(block["q_columns"]).reshape(row["dims"], -1).T)
                # rows that repeat an id are queries of their own: numbered within the block
                copies = _copies(query_ids.tolist())
                found += [(query_ids[at], copies[at], i, s) for at, i, s in search_block(matrix, query_ids, columns, ids, k)]
        size = [len(i) for _, _, i, _ in found]
        return pa.table({
            "query_id": np.repeat(np.array([x for x, _, _, _ in found], np.int64), size),
            "copy": np.repeat(np.array([x for _, x, _, _ in found], np.int64), size),
            "vec_id": np.concatenate([x for _, _, x, _ in found]) if found else np.zeros(0, np.int64),
            "score": np.concatenate([x for _, _, _, x in found]) if found else np.zeros(0, np.int64)})

    best = asked.repartition(parts, *keys).groupBy(*keys).cogroup(given.repartition(parts, *keys).groupBy(*keys)).applyInArrow(
        run, "query_id long, copy long, vec_id long, score long")
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _copies(ids: list[int]) -> np.ndarray:
    seen: dict[int, int] = {}
    out = []
    for i in ids:
        out.append(seen.get(i, 0))
        seen[i] = out[-1] + 1
    return np.array(out, np.int64)


def op6_topk_search(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.r <> q.r AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
