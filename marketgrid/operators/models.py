"""Fitting and scoring as Spark jobs (M02-M04, M06) and components of rows that share atoms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import full, later, ratio
from ..sources.scratch import Scratch
from ..sources.tables import bars_daily
from .components import components
from .trailing import AVERAGES, RETURNS

#: Features with the limits that clip them.
LIMITS = {"ret_1": 2.0, "ret_5": 2.0, "ret_20": 2.0, "bias20": 2.0, "volatility20": 3.0, "vol_ratio": 5.0}
FEATURES = list(LIMITS)
STAGES = (
    RETURNS | {"ma20": AVERAGES["ma20"], "vol_ratio": ratio("volume", full("avg", "volume", 20, 1)), "target": f"{ratio(later('close', 5), 'close')} - 1"},
    {
        "bias20": "close / ma20 - 1", "volatility20": full("stddev_pop", "ret_1", 20),
        "klass": "CASE WHEN target > 0.03 THEN 2 WHEN target < -0.03 THEN 0 WHEN target IS NOT NULL THEN 1 END",
    },
)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, not clipped, and class of every bar."""
    rows = bars_daily(spark, sf_dir)
    for stage in STAGES:
        rows = rows.selectExpr("*", *(f"{e} AS {name}" for name, e in stage.items()))
    return rows.select("symbol", "date", *FEATURES, "klass")


def sampled(rows: DataFrame) -> DataFrame:
    """Clipped features, class and chronological half of those rows of :func:`featured` that have all features and a mature label."""
    clip = lambda x, n: F.greatest(F.lit(-n), F.least(F.lit(n), F.col(x))).alias(x)
    return rows.dropna(subset=[*FEATURES, "klass"]).select(
        "symbol", "date", *(clip(x, n) for x, n in LIMITS.items()), F.col("klass").cast("double").alias("label"),
        (F.col("date") < F.to_date(F.lit("1999-01-01"))).alias("train"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(featured(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scratch]:
    """Samples with their vector, made once: fits and losses pass over them many times, and each pass would make the bars and their windows anew."""
    scratch = Scratch(spark)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scratch.write(samples(spark, sf_dir), "samples")), scratch


def _probabilities(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("symbol", "date", "label", vector_to_array("probability").alias("p"))


def log_ratios(rows: DataFrame, classes: int) -> DataFrame:
    """Log of each class's probability over the own one's, all that log losses need; null where the own class was not fitted."""
    log = lambda x: F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(1e-12))))
    own = log(F.get("p", F.col("label").cast("int")))
    return rows.select(*((log(F.get("p", F.lit(k))) - own).alias(f"r{k}") for k in range(classes)))


def log_losses(ratios: DataFrame, temperatures: Sequence[float]) -> list[float | None]:
    """Mean log loss after dividing log probabilities by each of the temperatures; one aggregate for all."""
    own = lambda t: F.ln(sum((F.exp(F.col(r) * F.lit(1.0 / t)) for r in ratios.columns[1:]), F.exp(F.col(ratios.columns[0]) * F.lit(1.0 / t))))
    return list(ratios.agg(*(F.avg(own(t)).alias(f"loss{k}") for k, t in enumerate(temperatures))).first())


def log_loss(rows: DataFrame, classes: int) -> float | None:
    return log_losses(log_ratios(rows, classes), [1.0])[0]


def m02_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic models for three strengths, the best by log loss on the tuning half; its class shares."""
    rows, _ = _stored(spark, sf_dir)
    fit, tune = rows.filter("train"), rows.filter("NOT train")
    n = max(1, fit.count())
    models = [LogisticRegression(family="multinomial", regParam=1.0 / (c * n), maxIter=50).fit(fit) for c in (0.1, 1.0, 10.0)]
    best = min(models, key=lambda m: log_loss(_probabilities(m, tune), m.numClasses))
    return _probabilities(best, tune).select("symbol", "date", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)))


def m03_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive temperature by golden-section search; each step is one Spark aggregate."""
    rows, scratch = _stored(spark, sf_dir)
    model = LogisticRegression(family="multinomial", maxIter=30).fit(rows.filter("train"))
    held = log_ratios(_probabilities(model, rows.filter("NOT train")), model.numClasses).cache()
    n, low, high, g = held.count(), math.log(0.2), math.log(5.0), (math.sqrt(5) - 1) / 2
    for _ in range(12):
        a, b = high - g * (high - low), low + g * (high - low)
        at_a, at_b = log_losses(held, [math.exp(a), math.exp(b)])
        if at_a < at_b:
            high = b
        else:
            low = a
    t = math.exp((low + high) / 2)
    loss = log_losses(held, [t])[0]
    held.unpersist()
    scratch.drop("samples")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(round(t, 4)).alias("temperature"), F.lit(round(loss, 6)).alias("log_loss"))


def m04_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-parameter calibration by Newton steps from Spark sums."""
    rows = samples(spark, sf_dir).select(F.col("ret_5").alias("s"), (F.col("label") == 2).cast("double").alias("y")).cache()
    a, b, n = 0.0, 0.0, 0
    for _ in range(8):
        p = 1 / (1 + F.exp(-(F.col("s") * a + b)))
        w = p * (1 - p)
        r = rows.agg(
            F.sum((F.col("y") - p) * F.col("s")), F.sum(F.col("y") - p), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w), F.count("*")
        ).first()
        ga, gb, haa, hab, hbb, n = r
        det = haa * hbb - hab * hab if n else 0.0
        if not det:
            break
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    rows.unpersist()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(round(a, 5)).alias("slope"), F.lit(round(b, 5)).alias("intercept"))


def m06_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small three-class perceptron (sigmoid layers) scored on the later half."""
    rows, _ = _stored(spark, sf_dir)
    model = MultilayerPerceptronClassifier(layers=[len(FEATURES), 8, 3], seed=5, maxIter=40).fit(rows.filter("train"))
    scored = model.transform(rows.filter("NOT train"))
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def components_of(pairs: DataFrame) -> DataFrame:
    """``node``, ``label``, ``size`` and ``weight`` of all nodes of an edge table (a, b: long), by contraction."""
    label = components(Scratch(pairs.sparkSession), pairs, "atoms")
    size = label.groupBy("label").agg(F.count("*").alias("size"))
    return label.join(size, "label").select("node", "label", "size", F.round(1 / F.col("size"), 8).alias("weight"))


def a41_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of suppliers and parts that share lines, over all lines, with inverse-size weights.

    The recursion is too slow for SQL on all lines; a union-find holds it in the tests.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return components_of(lines.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


def a41_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier name of :func:`a41_components`."""
    return a41_components(spark, sf_dir)


QUERIES = {f.__name__: f for f in (m02_logistic, m03_temperature, m04_platt, m06_mlp, a41_components, a41_components_all)}
ORACLE: dict[str, str] = {}
