"""Scores from a fitted model that is kept by version."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from ..sources.stores import shared
from ..sources.versioned import manifest, read_table, upsert
from .models import FEATURES, LIMITS, featured, log_losses, log_ratios, sampled
from .models import _probabilities as probabilities

ROWS = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("trained_until", T.DateType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("klass", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType()),
])
#: Name of the constant among a class's weights; temperatures that are tried; days that a label looks ahead.
CONSTANT, TEMPERATURES, HORIZON_DAYS = "", (0.5, 0.7, 1.0, 1.4, 2.0, 2.8), 5


@dataclass(frozen=True)
class Model:
    """Weights of each class by feature, the temperature that divides logits, and the last day that training saw."""

    version: str
    trained_until: dt.date
    temperature: float
    weights: dict[int, dict[str, float]]


def fit(rows: DataFrame, version: str, until: dt.date, c: float = 1.0) -> Model:
    """Fit on samples whose label was known by ``until``: the earlier four fifths of their days for the weights, the rest for the temperature."""
    known = rows.filter(F.date_add("date", HORIZON_DAYS) <= F.lit(until))
    first, last = known.agg(F.min("date"), F.max("date")).first()
    if first is None:
        raise ValueError(f"no sample is known by {until}")
    cut = first + (last - first) * 4 // 5
    made = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    early = made.filter(F.col("date") <= F.lit(cut))
    fitted = LogisticRegression(family="multinomial", regParam=1.0 / (c * max(1, early.count())), maxIter=50).fit(early)
    late = log_ratios(probabilities(fitted, made.filter(F.col("date") > F.lit(cut))), fitted.numClasses)
    best = min(zip(log_losses(late, TEMPERATURES), TEMPERATURES, strict=True), key=lambda x: x[0] or 0.0)[1]
    matrix, constant = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = {k: dict(zip(FEATURES, map(float, matrix[k]), strict=True)) | {CONSTANT: float(constant[k])} for k in range(len(constant))}
    return Model(version, until, best, weights)


def save(spark: SparkSession, model: Model, path: str) -> bool:
    """Keep a model under its version; a version that is there already stays as it is (False)."""
    rows = [(model.version, model.trained_until, model.temperature, k, f, w) for k, own in model.weights.items() for f, w in own.items()]
    return upsert(spark, spark.createDataFrame(rows, ROWS), path, ["version", "klass", "feature"], "weight", "version", model.version, moves=False)


def load(spark: SparkSession, path: str, version: str | None = None) -> Model:
    """A version, or the one that was kept last; its rows are as few as classes times features."""
    kept = manifest(spark, path).commits
    version = version or (kept[-1] if kept else None)
    rows = read_table(spark, path, ROWS, "version", [version] if version else []).collect()
    if not rows:
        raise LookupError(f"no model {version} in {path}")
    weights: dict[int, dict[str, float]] = {}
    for r in rows:
        weights.setdefault(r.klass, {})[r.feature] = r.weight
    return Model(rows[0].version, rows[0].trained_until, rows[0].temperature, weights)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``status``, probabilities and a score from 0 to 100: 100 (P(up) + P(flat) / 2).

    A row of a day that training could see is not scored, nor one that lacks a feature.
    """
    logits = [sum((F.col(f) * w for f, w in own.items() if f != CONSTANT), F.lit(own[CONSTANT])) / model.temperature for _, own in sorted(model.weights.items())]
    top = F.greatest(*logits)
    odds = [F.exp(z - top) for z in logits]
    total = sum(odds[1:], odds[0])
    missing = F.lit(False)
    for f in FEATURES:
        missing = missing | F.col(f).isNull() | F.isnan(f)
    status = F.when(F.col("date") <= F.lit(model.trained_until), "in_training").when(missing, "missing").otherwise("scored")
    shown = lambda x, n: F.when(F.col("status") == "scored", F.round(x, n))
    out = rows.withColumn("status", status)
    return out.select(*rows.columns, "status", F.lit(model.version).alias("version"), *(shown(o / total, 6).alias(f"p{k}") for k, o in enumerate(odds)), shown(100 * (odds[2] + odds[1] / 2) / total, 4).alias("score"))


def clipped(rows: DataFrame) -> DataFrame:
    """Clipped features of every bar, whether its label is known or not."""
    clip = lambda x, n: F.when(F.col(x).isNotNull(), F.greatest(F.lit(-n), F.least(F.lit(n), F.col(x)))).alias(x)
    return rows.select("symbol", "date", *(clip(x, n) for x, n in LIMITS.items()))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipped(featured(spark, sf_dir))


def m05_model_scores(spark: SparkSession, sf_dir: str, until: str = "1998-12-31") -> DataFrame:
    """Every bar scored by a model that was fitted on labels known by a day, kept, and loaded again; the bars' features are made once for both."""
    at, rows = shared(spark), Scratch(spark).write(featured(spark, sf_dir), "features")
    save(spark, fit(sampled(rows), f"until-{until}", dt.date.fromisoformat(until)), at)
    return score(clipped(rows), load(spark, at)).select("symbol", "date", "status", "version", "p0", "p1", "p2", "score")


QUERIES = {"m05_model_scores": m05_model_scores}
ORACLE: dict[str, str] = {}
