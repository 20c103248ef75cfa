"""What forbids an entry that rests on a forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import table


@dataclass(frozen=True)
class Limits:
    """Least expected return, share of rising paths and score; samples that a forecast needs, and the largest that is plausible."""

    expected: float = 0.0
    up: float = 0.5
    score: float = 50.0
    samples: int = 16
    largest: float = 4.0


def forecast_gate(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``rows`` (samples: array<double>, score: double) with usability, median, share of rising samples, and ``reasons`` in order.

    A forecast that is not usable has no direction to judge, and one whose summary is missing no share;
    the score is judged by itself, pending where there is none.
    """
    finite = F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limits.largest))
    usable = F.coalesce((F.size("samples") >= limits.samples) & finite, F.lit(False))
    ordered, n = F.array_sort("samples"), F.size("samples")
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    out = rows.withColumns({"usable": usable, "expected": F.when(usable, F.round(middle, 6)), "up": F.when(usable, F.round(F.size(F.filter("samples", lambda x: x > 0)) / n, 6))})
    why = C.reasons(
        forecast_missing_or_unusable=~F.col("usable"), forecast_direction_blocked=F.col("usable") & ((F.col("expected") <= limits.expected) | (F.col("up") < limits.up)),
        score_pending=F.col("score").isNull(), score_below_threshold=F.col("score") < limits.score,
    )
    return out.withColumn("reasons", why)


def p27_forecast_policy(spark, sf_dir):
    """Embeddings as sample returns, their labels as the classes of a score: 100 for the upper half of the labels' range, 0 at its low end."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), "label")
    top = rows.agg(F.max("label").alias("top"))
    score = F.when(F.col("vec_id") % 10 > 0, F.round(100.0 * F.least(F.lit(1.0), 2 * F.col("label") / F.nullif("top", F.lit(0))), 4))
    judged = forecast_gate(rows.crossJoin(F.broadcast(top)).withColumn("score", score))  # one row
    return judged.select("vec_id", "usable", "expected", "up", "score", F.array_join("reasons", ",").alias("reasons"))


ORACLE = {
    "p27_forecast_policy": """WITH t AS (SELECT max(label) AS top FROM embeddings),
x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
u AS (SELECT vec_id, count(*) >= 16 AND count(*) FILTER (x IS NULL OR isnan(x) OR abs(x) > 4.0) = 0 AS usable, median(x) AS mid, avg(CAST(x > 0 AS INT)) AS up FROM x GROUP BY vec_id),
j AS (SELECT e.vec_id, coalesce(usable, false) AS usable, CASE WHEN usable THEN round(mid, 6) END AS expected, CASE WHEN usable THEN round(u.up, 6) END AS up,
  CASE WHEN e.vec_id % 10 > 0 THEN round(100.0 * least(1.0, 2 * label / nullif(top, 0)), 4) END AS score FROM embeddings e LEFT JOIN u USING (vec_id), t)
SELECT vec_id, usable, expected, up, score, concat_ws(',', CASE WHEN NOT usable THEN 'forecast_missing_or_unusable' END, CASE WHEN usable AND (expected <= 0 OR up < 0.5) THEN 'forecast_direction_blocked' END,
  CASE WHEN score IS NULL THEN 'score_pending' END, CASE WHEN score < 50 THEN 'score_below_threshold' END) AS reasons FROM j""",
}
QUERIES = {"p27_forecast_policy": p27_forecast_policy}
