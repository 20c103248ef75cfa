"""Whole-table measures without a single task for all rows: class metrics (A20), global ranks (A22), fingerprints (A38), costs by liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import sql
from ..sources.scratch import Scratch
from ..sources.tables import bars_daily, fills, table
from .evidence import as_of
from .trailing import PLANS


def sums_below(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """``rows`` (one for each value) with ``below``, the weights of all smaller values.

    Ranges of values are sorted side by side; a range's own running sum plus the totals of the ranges
    before give the global one, so the only unpartitioned window has a row for each task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, value).withColumn("task", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession).write(ranged, "ranges")
    totals = ranged.groupBy("task").agg(F.sum(weight).alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    starts = totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("task").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("own", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return own.join(starts, "task").withColumn("below", F.col("own") + F.col("start")).drop("task", "own", "start")


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by average ranks of the scores; null without both labels."""
    steps = rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranked = sums_below(steps, "score", "n").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    pairs = F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))
    return total.select("n", "p", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / pairs).alias("auc"))


def a22_auc_fine(spark, sf_dir):
    """AUC of documents' length against their label: scores as fine as the data, ranked by ranges."""
    scored = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality IS NOT NULL AND n_chars IS NOT NULL")
    return auc(scored.select((F.col("n_chars") + F.col("doc_id") / 1e9).alias("score"), "quality"), "score", "quality").select("n", "p", F.round("auc", 6).alias("auc"))


def day_digests(bars: DataFrame) -> DataFrame:
    """A digest of each day's bars in order of symbol: the leaves of a table's fingerprint, which one day's symbols bound in size."""
    ticks = lambda x: F.floor(F.col(x) * 100).cast("long").cast("string")
    row = F.concat_ws("|", F.col("symbol").cast("string"), F.col("date").cast("string"), *(ticks(x) for x in ("close", "volume", "amount")), F.col("verified").cast("string"))
    rows = bars.select("date", F.struct("symbol", F.sha2(row, 256).alias("h")).alias("leaf"))
    return rows.groupBy("date").agg(F.count("*").alias("n"), _joined("leaf").alias("digest"))


def _joined(leaf: str):
    """Digest of the digests ``h`` of a group's leaves in their order."""
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["h"])), 256)


def fingerprint(days: DataFrame) -> DataFrame:
    """(level, part, n, digest): months over day digests in order, and the table over its months."""
    months = days.groupBy(F.date_format("date", "yyyy-MM").alias("part")).agg(F.sum("n").alias("n"), _joined_of("date").alias("digest"))
    whole = months.agg(F.sum("n").alias("n"), _joined_of("part").alias("digest"))
    return months.select(F.lit("month").alias("level"), "part", "n", "digest").union(whole.select(F.lit("table"), F.lit("*"), "n", "digest"))


def _joined_of(order: str):
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("digest").alias("h")))), lambda x: x["h"])), 256)


def refreshed(days: DataFrame, changed: DataFrame, dates: DataFrame) -> DataFrame:
    """Day digests after the bars of ``dates`` became ``changed``: the other days' bars aren't read."""
    return days.join(dates, "date", "left_anti").unionByName(day_digests(changed))


def a38_table_fingerprint(spark, sf_dir):
    """The table's fingerprint by day, month and as a whole."""
    return fingerprint(day_digests(bars_daily(spark, sf_dir)))


def class_metrics(rows: DataFrame, by: str, label: str, p: list[str], priors: DataFrame) -> DataFrame:
    """Loss, Brier score and accuracy of class probabilities by part, with the loss of always naming the training shares.

    ``priors`` has one row with the shares ``s0``, ``s1``, ...; the first of equal probabilities is the class named.
    """
    own = F.get(F.array(*p), F.col(label))
    named = F.array_position(F.array(*p), F.greatest(*p)) - 1
    brier = sum((F.pow(F.col(x) - (F.col(label) == k).cast("double"), 2) for k, x in enumerate(p)), F.lit(0.0))
    base = F.get(F.array(*(f"s{k}" for k in range(len(p)))), F.col(label))
    loss = lambda x: F.avg(-F.ln(F.greatest(x, F.lit(1e-12))))
    per = rows.crossJoin(F.broadcast(priors)).groupBy(by).agg(  # one row
        F.count("*").alias("n"), loss(own).alias("log_loss"), F.avg(brier).alias("brier"), F.avg((named == F.col(label)).cast("double")).alias("accuracy"), loss(base).alias("prior_loss"),
        *(F.count_if(F.col(label) == k).alias(f"n{k}") for k in range(len(p))),
    )
    return per.withColumn("skill", 1 - F.col("log_loss") / F.col("prior_loss"))


def a20_class_metrics(spark, sf_dir, train_until: str = "1998-01-01"):
    """Three classes of the return over the next five bars against the batch score's probabilities, by year after training, with the training shares as baseline."""
    by = Window.partitionBy("symbol").orderBy("date")
    ahead, z = F.lead("close", 5).over(by) / F.col("close") - 1, F.round(F.col("close") / F.col("open") - 1, 6) * 5
    odds = [F.exp(x / 1.5) for x in (F.least(z, F.lit(20.0)), F.lit(0.2), F.greatest(-z, F.lit(-20.0)))]
    total = odds[0] + odds[1] + odds[2]
    klass = F.when(ahead > 0.03, 2).when(ahead < -0.03, 0).when(ahead.isNotNull(), 1)
    rows = bars_daily(spark, sf_dir).select(F.col("date"), klass.alias("klass"), *((odds[k] / total).alias(f"p{k}") for k in range(3))).filter("klass IS NOT NULL")
    early = F.col("date") < F.lit(train_until).cast("date")
    shares = rows.filter(early).agg(*(F.avg((F.col("klass") == k).cast("double")).alias(f"s{k}") for k in range(3)))
    found = class_metrics(rows.filter(~early).withColumn("year", F.year("date")), "year", "klass", ["p0", "p1", "p2"], shares)
    return found.select("year", "n", "n0", "n1", "n2", *(F.round(x, 6).alias(x) for x in ("log_loss", "brier", "accuracy", "prior_loss", "skill")))


#: The supplied amounts are thousandths of those that the cost tiers are for.
THOUSAND = 1000.0


def p22_costs(spark, sf_dir):
    """Slippage, fee and execution price of each fill by its symbol's mean amount over the 20 bars up to the fill's day; without five of them it pays as the least liquid."""
    rows = fills(spark, sf_dir).withColumn("symbol", F.col("account") % 100)
    mean = PLANS["w20_mean_amount"].frame(spark, sf_dir).select("symbol", "date", "mean_amount20").withColumnRenamed("date", "bar")
    rows = as_of(rows, mean, ["symbol"], "date", "bar", ["mean_amount20"])
    rate = C.slippage_rate(F.col("mean_amount20") * THOUSAND)
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return rows.select(
        "fill_id", "side", F.round(F.col("mean_amount20") + 1e-7, 2).alias("mean_amount"), rate.alias("slippage"), C.fee(F.col("side"), F.col("notional")).alias("fee"), (F.col("notional") * (1 + sign * rate)).alias("executed"),
    )


_RATE = "CASE WHEN m IS NULL OR m <= 0 THEN 0.0025::DOUBLE " + " ".join(f"WHEN m * 1000 <= {most} THEN {of}::DOUBLE" for most, of in C.IMPACT_TIERS) + f" ELSE {C.DEEPEST}::DOUBLE END"
_FEE = f"greatest(notional * {C.COMMISSION}::DOUBLE, {C.MIN_COMMISSION}) + CASE WHEN side = 'SELL' THEN notional * {C.SELL_TAX}::DOUBLE ELSE 0 END"
_LEAF = "sha256(concat_ws('|', symbol, date, CAST(floor(close * 100) AS BIGINT), CAST(floor(volume * 100) AS BIGINT), CAST(floor(amount * 100) AS BIGINT), verified))"
ORACLE = {
    "a20_class_metrics": sql.with_(sql.BARS)[:-1] + """, z AS (SELECT date, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS ahead, round(close / open - 1, 6) * 5 AS z FROM bars),
o AS (SELECT date, CASE WHEN ahead > 0.03::DOUBLE THEN 2 WHEN ahead < -0.03::DOUBLE THEN 0 ELSE 1 END AS klass, exp(least(z, 20.0) / 1.5) AS a, exp(0.2::DOUBLE / 1.5) AS b, exp(greatest(-z, -20.0) / 1.5) AS c FROM z WHERE ahead IS NOT NULL),
p AS (SELECT date, klass, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM o),
s AS (SELECT avg(CAST(klass = 0 AS INT)) AS s0, avg(CAST(klass = 1 AS INT)) AS s1, avg(CAST(klass = 2 AS INT)) AS s2 FROM p WHERE date < DATE '1998-01-01'),
m AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (klass = 0) AS n0, count(*) FILTER (klass = 1) AS n1, count(*) FILTER (klass = 2) AS n2, avg(-ln(greatest([p0, p1, p2][klass + 1], 1e-12))) AS ll,
  avg((p0 - CAST(klass = 0 AS INT)) ** 2 + (p1 - CAST(klass = 1 AS INT)) ** 2 + (p2 - CAST(klass = 2 AS INT)) ** 2) AS br, avg(CAST(list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 = klass AS INT)) AS ac, avg(-ln([s0, s1, s2][klass + 1])) AS pl
  FROM p, s WHERE date >= DATE '1998-01-01' GROUP BY 1)
SELECT year, n, n0, n1, n2, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(ac, 6) AS accuracy, round(pl, 6) AS prior_loss, round(1 - ll / pl, 6) AS skill FROM m""",
    "a22_auc_fine": "WITH s AS (SELECT n_chars + doc_id / 1e9 AS score, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)"
    " SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS p, round((sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r",
    "a38_table_fingerprint": sql.with_(sql.BARS)[:-1] + f", d AS (SELECT date, count(*) AS n, sha256(string_agg({_LEAF}, '' ORDER BY symbol)) AS digest FROM bars GROUP BY date), m AS (SELECT strftime(date, '%Y-%m') AS part, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY date)) AS digest FROM d GROUP BY 1)"
    " SELECT 'month' AS level, part, n, digest FROM m UNION ALL SELECT 'table', '*', CAST(sum(n) AS BIGINT), sha256(string_agg(digest, '' ORDER BY part)) FROM m",
    "p22_costs": sql.with_(sql.FILLS)[:-1] + ", w AS (" + PLANS["w20_mean_amount"].oracle() + f"), j AS (SELECT f.*, mean_amount20 AS m FROM (SELECT *, account % 100 AS symbol FROM fills) f ASOF LEFT JOIN w ON f.symbol = w.symbol AND f.date >= w.date) SELECT fill_id, side, round(m + 1e-7, 2) AS mean_amount, {_RATE} AS slippage, {_FEE} AS fee, notional * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * {_RATE}) AS executed FROM j",
}
QUERIES = {name: globals()[name] for name in ORACLE}
