"""Exact top-k inner products by the threshold algorithm (operator 6)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

#: Vectors and queries that meet in one task.
BLOCK, QUERY_BLOCK = 4096, 1024
_FIRST_DEPTH = 8
#: Components from here on are wide: sums of their products might not be whole in 64 bits of floating point.
WIDE = 4096.0
_LONG = (-(1 << 63), (1 << 63) - 1)


def threshold_topk(
    vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int, floors: np.ndarray
) -> list[tuple[int, int, int]]:
    """(query row, vector id, score) of each query's ``k`` best vectors other than its own row, ties to smaller ids.

    Every dimension has a list of the vectors sorted by it, read from the end that the query's sign
    prefers.  After each stretch of sorted access the new vectors are scored in full; a query is
    done when its kth score, or the ``floors`` score that its result is known to reach, beats what
    the lists' next entries could add up to.  Components are whole numbers, as floats that hold
    every sum exactly or, for wide ones, as Python integers.
    """
    n = len(vectors)
    order = np.argsort(vectors, axis=0, kind="stable")
    up = np.take_along_axis(vectors, order, 0)
    rising, falling = np.minimum(queries, 0), np.maximum(queries, 0)
    depths, depth = [], _FIRST_DEPTH
    while depth < n:
        depths.append(depth)
        depth *= 2
    depths.append(n)
    # What a vector not yet seen at a depth can score at most, for all queries at once.
    bounds = {d: up[n - 1 - d] @ falling.T + up[d] @ rising.T for d in depths[:-1]}
    out = []
    for q, query in enumerate(queries):
        high, low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        best_ids, best = np.empty(0, np.int64), np.empty(0, vectors.dtype)
        done = 0
        for depth in depths:
            now = np.zeros(n, bool)
            if depth == n:
                now[:] = True
            else:
                now[order[n - depth : n - done, high].ravel()] = True
                now[order[done:depth, low].ravel()] = True
            new = np.flatnonzero(now & ~seen)
            seen |= now
            scores = vectors[new] @ query
            good = (scores >= (best[-1] if len(best) == k else floors[q])) & (rows[new] != query_rows[q])
            new, scores = new[good], scores[good]
            all_ids, all_scores = np.r_[best_ids, ids[new]], np.r_[best, scores]
            keep = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[keep], all_scores[keep]
            reached = best[-1] if len(best) == k else floors[q]
            if depth == n or reached > bounds[depth][q]:
                break
            done = depth
        out += [(int(query_rows[q]), int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]
    return out


def whole(components: list[np.ndarray], wide: bool) -> np.ndarray:
    """floor(256 x) of vectors: floats, or Python integers where they are wide."""
    x = np.stack([np.asarray(c, np.float64) for c in components])
    if not wide:
        return np.floor(x * 256)
    return np.array([[int(c) * 256 if abs(c) >= 2.0**53 else math.floor(c * 256) for c in row] for row in x.tolist()], object)


def fit_vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) as doubles; vectors that are null, empty or hold a null or non-finite component go."""
    x = F.col(vector_col).cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (
        frame.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
        .filter(F.coalesce(fit, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    )


def search(
    frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of all rows for rows whose id divides by ``every``.

    The stated queries meet all rows in blocks: each pair of a block of queries and a block of
    vectors is one group of bounded size, and hashing the rows deals them out evenly even if
    many are equal.  Each query first meets one block; the ``k``th score there is where its lists in
    all other blocks may stop.  Only ``k`` rows for each query leave a block.  Vectors of another
    length than a query's score nothing with it.  Rows are told apart by number, not by id: repeated
    rows compete row by row, and each of several query rows of one id has its own list.  Wide vectors
    (a component of 4,096 or more) meet in blocks of their own and are scored in unbounded integers;
    scores that a long can't hold are ranked as they are and shown as the nearest long.  Too few rows
    give fewer ranks; an empty table gives none.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark)
    numbered = fit_vectors(frame, id_col, vector_col).withColumns(
        {"row": F.monotonically_increasing_id(), "dims": F.size("v"), "wide": F.exists("v", lambda c: F.abs(c) >= WIDE).cast("int")}
    )
    vectors = scratch.write(numbered, "vectors")
    is_query = F.col("vec_id") % every == 0
    counts = vectors.agg(F.count("*"), F.count_if(is_query), F.max("wide"), F.max(F.when(is_query, F.col("wide")))).first()
    n, n_queries, wide, wide_queries = (x or 0 for x in counts)
    per_kind, queries_per_kind = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    blocks, query_blocks = per_kind * (1 + wide), queries_per_kind * (1 + wide_queries)
    placed = vectors.withColumns({
        "block": F.pmod(F.xxhash64("row"), F.lit(per_kind)) + F.col("wide") * per_kind,
        "query_block": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(queries_per_kind)) + F.col("wide") * queries_per_kind,
    })
    queries = placed.filter(is_query)
    every_block = F.expr(f"explode(sequence(0L, {blocks - 1}L))")
    every_query_block = F.expr(f"explode(sequence(0L, {query_blocks - 1}L))")
    left = placed.select("row", "vec_id", "v", "dims", "wide", "block", every_query_block.alias("query_block"))
    asked = queries.select(
        F.col("row").alias("of"), F.col("v").alias("asked"), F.col("dims").alias("of_dims"), F.col("wide").alias("wide_query"),
        F.col("query_block").alias("of_query_block"),
    )

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            large = bool(a.wide.any() or b.wide_query.any())
            floors = [int(x) if large else float(x) for x in b.floor]
            found = threshold_topk(
                whole(a.v.to_list(), large), a.vec_id.to_numpy(), a.row.to_numpy(), whole(b.asked.to_list(), large), b.of.to_numpy(), k,
                np.array(floors, object if large else float),
            )
            rows = [(r, i, str(s)) for r, i, s in found]
        return pd.DataFrame({"query_row": [r[0] for r in rows], "vec_id": [r[1] for r in rows], "score": [r[2] for r in rows]}).astype(
            {"query_row": "int64", "vec_id": "int64", "score": "object"}
        )

    keys = ["block", "query_block", "dims"]

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        found = a.groupBy(*keys).cogroup(b.groupBy(*(f"of_{x}" for x in keys))).applyInPandas(run, "query_row long, vec_id long, score string")
        # Few scores need more than a long; those are ranked by sign, length and digits.
        return found.withColumn("exact", F.expr("try_cast(score AS decimal(38, 0))"))

    # No score is below this floor.
    lowest = F.lit("-" + "9" * 700)
    home = F.pmod(F.xxhash64("of", F.lit(2)), F.lit(per_kind)) + F.col("wide_query") * per_kind
    first = scratch.write(meet(left, asked.withColumns({"of_block": home, "floor": lowest})), "first")
    kth = first.withColumn("at", F.row_number().over(_ranks("query_row"))).filter(F.col("at") == k).select(F.col("query_row").alias("known"), F.col("score").alias("floor"))
    rest = asked.withColumns({"home": home, "of_block": every_block}).filter("of_block <> home").drop("home")
    rest = rest.join(kth, F.col("of") == F.col("known"), "left").withColumn("floor", F.coalesce("floor", lowest)).drop("known")
    best = first.unionByName(meet(left, rest))
    ranked = best.withColumn("rank", F.row_number().over(_ranks("query_row"))).filter(F.col("rank") <= k)
    named = ranked.join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row")
    score = F.coalesce(
        F.expr("try_cast(score AS bigint)"), F.when(F.col("score").startswith("-"), F.lit(_LONG[0])).otherwise(F.lit(_LONG[1]))
    )
    return named.select("query_id", "rank", "vec_id", score.alias("score"))


def _ranks(key: str):
    """Highest whole numbers first, as decimals or, beyond them, by sign, number of digits and digits; then smaller ids."""
    low = F.col("score").startswith("-")
    digits = F.length("score")
    beyond = F.when(F.col("exact").isNotNull(), 0).when(low, -1).otherwise(1)
    return Window.partitionBy(key).orderBy(
        F.desc(beyond), F.desc("exact"), F.desc(F.when(low, -digits).otherwise(digits)), F.when(low, F.col("score")), F.desc("score"), "vec_id"
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


OP6_SQL = """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
