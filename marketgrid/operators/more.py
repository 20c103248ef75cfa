"""Further projections, joins, gates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import sql
from ..sources.tables import bars_daily, calendar, fills, industry_of, signals, table
from .evidence import as_of


#: Columns that daily bars need.
NEEDED = ("symbol", "date", "open", "high", "low", "close", "volume")


def p04_validate_daily(spark, sf_dir):
    """Validity of each listed symbol: no rows, missing columns, too few rows, missing dates, missing or bad prices, inverted ranges, negative volume, duplicate dates."""
    rows = bars_daily(spark, sf_dir)
    missing = ",".join(x for x in NEEDED if x not in rows.columns)
    price = F.least("open", "high", "low", "close")
    per = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), (F.count("*") < 60).alias("few"), F.count_if(F.col("date").isNull()).alias("bad_date"), F.count_if(F.col("close").isNull()).alias("no_price"),
        F.count_if(price <= 0).alias("bad_price"), F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("high_below"), F.count_if(F.col("low") > F.least("open", "close", "high")).alias("low_above"),
        F.count_if(F.col("volume") < 0).alias("negative"), (F.count("date") - F.count_distinct("date")).alias("duplicates"),
    )
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol")).join(per, "symbol", "left")
    why = C.reasons(
        empty=F.col("n").isNull(), missing_columns=F.lit(missing != ""), too_few_rows=F.col("few"), bad_date=F.col("bad_date") > 0, missing_price=F.col("no_price") > 0,
        ohlc_non_positive=F.col("bad_price") > 0, high_below_ohlc=F.col("high_below") > 0, low_above_ohlc=F.col("low_above") > 0, negative_volume=F.col("negative") > 0,
        duplicate_dates=F.col("duplicates") > 0,
    )
    return listed.select("symbol", F.coalesce("n", F.lit(0)).alias("rows"), F.array_join(why, ",").alias("issues"), (F.size(why) == 0).alias("ok"))


def p08_external_history(spark, sf_dir):
    """Users as outside instruments: daily last values from either of two aliased columns, bad geometry dropped."""
    rows = signals(spark, sf_dir).select(
        "symbol", F.to_date("available_at").alias("date"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("close_a"),
        F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("close_b"), "event_id",
    )
    rows = rows.withColumn("close", F.coalesce("close_a", "close_b")).filter("close > 0")
    return rows.groupBy("symbol", "date").agg(F.max_by("close", "event_id").alias("close"), F.max("close").alias("high"), F.min("close").alias("low"))


def p09_availability(spark, sf_dir):
    """A New York close at 16:00 local time as an instant of the session's clock (UTC)."""
    days = calendar(spark, sf_dir).select("date")
    local = F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS")
    return days.select("date", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local).alias("available"))


def p10_industry_code(spark, sf_dir):
    """Codes such as ``J07name`` split into two levels and the name."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("n_regionkey") + 1, F.lit(1)), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "n_name").alias("code"))
    part = lambda k: F.regexp_extract("code", r"^([A-Z])([0-9]{2})(.*)$", k)
    return rows.select("code", part(1).alias("l1"), F.concat(part(1), part(2)).alias("l2"), part(3).alias("name"))


def p13_finite(spark, sf_dir):
    """Ratios with NaN and infinities scrubbed to null, counted per symbol."""
    ratio = F.col("amount").cast("double") / F.nullif(F.col("n_lines") - 1, F.lit(0))
    return bars_daily(spark, sf_dir).withColumn("x", C.finite(ratio)).groupBy("symbol").agg(F.count("x").alias("known"), F.count_if(F.col("x").isNull()).alias("scrubbed"))


def p15_filter_page(spark, sf_dir, sources: tuple[str, ...] = ("src1", "src2", "src3"), word: str = "the", page: int = 2, size: int = 10):
    """A page of the documents of some sources that hold a word."""
    rows = table(spark, sf_dir, "documents").filter(F.col("source").isin(*sources) & F.contains(F.lower("text"), F.lit(word)))
    return rows.orderBy("doc_id").offset((page - 1) * size).limit(size).select("doc_id", "source")


def p16_search(spark, sf_dir, part: str = "ring"):
    return table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit(part))).select("p_partkey", "p_name")


def p18_row_class(spark, sf_dir):
    """Labelled documents as method rows: valid, failed, deferred or unavailable with reasons."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    klass = F.when(F.col("quality").isNull(), "unavailable").when(F.col("n_chars") < 200, "deferred").when(F.col("toxic") == 1, "failed").otherwise("valid")
    why = C.reasons(no_label=F.col("quality").isNull(), short=F.col("n_chars") < 200, toxic=F.col("toxic") == 1)
    return rows.select("doc_id", klass.alias("klass"), F.array_join(why, ",").alias("reasons"))


def p21_tick(spark, sf_dir):
    """Half-up ticks of retail prices raised by a tenth of a percent."""
    return table(spark, sf_dir, "part").select("p_partkey", C.tick(F.col("p_retailprice").cast("decimal(18,4)") * F.lit("1.001").cast("decimal(5,3)")).cast("double").alias("price"))


def p25_point_in_time(spark, sf_dir):
    """A value is null if its clock is after that day's close at 15:00."""
    late = F.date_format("available_at", "HH:mm:ss") > "15:00:00"
    return signals(spark, sf_dir).select("event_id", F.when(~late, F.col("value")).alias("value"))


def p27_forecast_gate(spark, sf_dir):
    """Usable forecasts: mean, share of rising components and spread within limits, with reasons."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    up = F.size(F.filter("v", lambda x: x > 0)) / n
    why = C.reasons(low_mean=F.round(mean, 6) < 0, few_up=up < 0.5)
    return rows.select("vec_id", F.round(up, 6).alias("up"), F.array_join(why, ",").alias("reasons"))


def p29_drill_down(spark, sf_dir, kind: str = "purchase", least: float = 90.0):
    """Days of users, filtered by what their nested events hold, with the ids of the day's supporting and resisting events."""
    rows = signals(spark, sf_dir).groupBy("symbol", F.to_date("available_at").alias("day")).agg(F.collect_list(F.struct("event_id", "event_type", "side", "value")).alias("events"))
    hit = F.exists("events", lambda e: (e["event_type"] == kind) & (e["value"] > least))
    ids = lambda side: F.array_join(F.array_sort(F.transform(F.filter("events", lambda e: e["side"] == side), lambda e: e["event_id"])), ",")
    return rows.filter(hit).select("symbol", "day", F.size("events").alias("n"), ids("BUY").alias("buys"), ids("SELL").alias("sells"))


def j04_profile_as_of(spark, sf_dir):
    """The last daily close at or before each month's end, for months with any bar."""
    bars = bars_daily(spark, sf_dir).select("symbol", "date", "close")
    months = bars.select("symbol", F.last_day("date").alias("month_end")).distinct()
    return as_of(months, bars, ["symbol"], "month_end", "date", ["close"]).select("symbol", "month_end", F.col("date_seen").alias("seen"), "close")


def j15_snapshot_compare(spark, sf_dir, least_coverage: float = 0.8):
    """Old and new classification of customers compared; a class that keeps less than ``least_coverage`` of its members is refused and stays as it was.

    The new snapshot lacks every seventh customer and moves every fifth; a second authority that names
    another class for a customer is a conflict and changes nothing.
    """
    key = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("old"))
    new = table(spark, sf_dir, "customer").filter(key % 7 != 0).select("c_custkey", F.when(key % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("new"), F.when(key % 11 == 0, "OTHER").alias("second"))
    conflict = F.col("second").isNotNull() & (F.col("second") != F.col("new"))
    state = F.when(F.col("new").isNull(), "dropped").when(conflict, "conflict").when(F.col("new") != F.col("old"), "changed").otherwise("kept")
    rows = old.join(new, "c_custkey", "left").withColumn("state", state)
    held = rows.groupBy("old").agg(F.avg((F.col("state") != "dropped").cast("double")).alias("coverage"))
    return rows.groupBy("old", "state").agg(F.count("*").alias("n")).join(held, "old").select(
        "old", "state", "n", F.round("coverage", 6).alias("coverage"), F.when(F.col("coverage") < least_coverage, "refused").otherwise("applied").alias("verdict")
    )


def k05_latest_date(spark, sf_dir, end: str = "1998-09-02"):
    return table(spark, sf_dir, "lineitem").filter(f"l_shipdate <= TIMESTAMP_NTZ '{end}'").agg(F.max(F.col("l_shipdate").cast("date")).alias("last"))


def a16_ranking_eligibility(spark, sf_dir):
    """Sources with at least five labelled documents that cover at least 80 % of theirs."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("known"))
    return rows.select("source", "n", "known", ((F.col("known") >= 5) & (F.col("known") * 5 >= F.col("n") * 4)).alias("eligible"))


def _legs(spark, sf_dir):
    """Daily mean returns of two halves of the symbols on the days when both trade."""
    r = F.col("close") / F.col("open") - 1
    rows = bars_daily(spark, sf_dir).withColumn("leg", F.col("symbol") % 2).groupBy("date").agg(
        F.avg(F.when(F.col("leg") == 0, r)).alias("a"), F.avg(F.when(F.col("leg") == 1, r)).alias("b")
    )
    return rows.filter("a IS NOT NULL AND b IS NOT NULL")


#: Sessions a year, and the least deviation of returns for which a Sharpe ratio is given.
ANNUAL, LEAST_DEVIATION = 252, 1e-14


def _differences(n: int = ANNUAL):
    """Cumulative return and Sharpe ratio of ``a`` less those of ``b``, as aggregates."""
    grown = lambda x: F.exp(F.sum(F.log1p(x)))
    sharpe = lambda x: F.when(F.stddev_samp(x) > LEAST_DEVIATION, F.sqrt(F.lit(float(n))) * F.avg(x) / F.stddev_samp(x))
    return [(grown("a") - grown("b")).alias("cumulative"), (sharpe("a") - sharpe("b")).alias("sharpe")]


def a32_paired_difference(spark, sf_dir):
    """Paired daily difference of two groups' mean returns over common days: mean, deviation, log growth and Sharpe ratio."""
    d = F.col("a") - F.col("b")
    out = _legs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("sd"), F.sum(F.log1p("a") - F.log1p("b")).alias("growth"), *_differences())
    return out.select("n", "mean", "sd", F.round("growth", 5).alias("log_growth"), F.round("sharpe", 5).alias("sharpe"))


def paired_draws(legs, draws: int, block: int, seed: int):
    """(draw, cumulative, sharpe) of series put together from blocks of ``block`` consecutive days, the same days for both.

    ``legs`` has one row per session.  Starts come from a seeded hash; the last block is cut so that
    each draw has as many days as the series.
    """
    legs = legs.withColumn("at", F.row_number().over(Window.orderBy("date")) - 1)  # one row per session
    size = legs.agg(F.count("*").alias("size"))
    spots = legs.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))  # one row
    spots = spots.filter(f"size >= {max(60, block)}").withColumn("spot", F.explode(F.expr("sequence(0, CAST(size AS int) - 1)")))
    start = F.pmod(F.xxhash64("draw", F.floor(F.col("spot") / block), F.lit(seed)), F.col("size") - block + 1)
    drawn = spots.select("draw", (start + F.col("spot") % block).cast("int").alias("at"))
    return drawn.join(legs, "at").groupBy("draw").agg(*_differences())


def a32_paired_bootstrap(spark, sf_dir, draws: int = 400, block: int = 20, seed: int = 17):
    """Paired moving-block bootstrap: estimates and 95 % intervals of the differences of cumulative return and Sharpe ratio."""
    legs = _legs(spark, sf_dir)
    drawn = paired_draws(legs, draws, block, seed)
    point = legs.agg(*_differences())
    out = drawn.agg(
        F.count("*").alias("draws"), F.count("sharpe").alias("sharpe_draws"),
        *(F.percentile(x, F.lit(p)).alias(f"{x}_{end}") for x in ("cumulative", "sharpe") for end, p in (("lower", 0.025), ("upper", 0.975))),
    )
    return point.crossJoin(out).select("draws", "sharpe_draws", *(F.round(x, 6).alias(x) for x in ("cumulative", "cumulative_lower", "cumulative_upper", "sharpe", "sharpe_lower", "sharpe_upper")))  # one row each


def u02_by_name(spark, sf_dir):
    """Suppliers and customers as one frame by name, missing columns null."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("segment").agg(F.count("*").alias("n"), F.count("balance").alias("known"))


def u06_pool(spark, sf_dir):
    """A pool of parts by size or brand, each once, with the supplier of its last line."""
    parts = table(spark, sf_dir, "part")
    pool = parts.filter("p_size > 45").select("p_partkey", "p_brand").union(parts.filter("p_brand = 'Brand#3'").select("p_partkey", "p_brand")).dropDuplicates(["p_partkey"])
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_suppkey").alias("supplier"))
    return pool.join(last, "p_partkey", "left").select("p_partkey", "p_brand", "supplier")


def s07_read_many(spark, sf_dir, symbols: tuple[int, ...] = tuple(range(0, 150, 10))):
    """Daily closes of a list of outside instruments in one scan."""
    wanted = spark.createDataFrame([(x,) for x in symbols], "symbol long")  # a short list
    rows = signals(spark, sf_dir).join(F.broadcast(wanted), "symbol", "left_semi")
    return rows.groupBy("symbol", F.to_date("available_at").alias("date")).agg(F.max_by("value", F.struct("available_at", "event_id")).alias("close"))


def _indexed(spark, sf_dir):
    return bars_daily(spark, sf_dir).join(calendar(spark, sf_dir), "date")


def w26_dependency(spark, sf_dir):
    """Whether the last 65 bars are verified and lie on 65 sessions in a row."""
    by = Window.partitionBy("symbol").orderBy("session")
    rows = _indexed(spark, sf_dir)
    span = F.col("session") - F.lag("session", 64).over(by)
    bad = F.sum((F.col("verified") == 0).cast("int")).over(by.rowsBetween(-64, 0))
    return rows.select("symbol", "date", span.alias("span"), bad.alias("bad"), F.coalesce((span == 64) & (bad == 0), F.lit(False)).alias("complete"))


def w29_interval_return(spark, sf_dir):
    """Own five-bar return less the industry's mean of the same."""
    by = Window.partitionBy("symbol").orderBy("date")
    own = bars_daily(spark, sf_dir).join(industry_of(spark, sf_dir), "symbol").withColumn("r", F.col("close") / F.lag("close", 5).over(by) - 1)
    mean = own.groupBy("board", "date").agg(F.avg("r").alias("peer"))
    return own.join(mean, ["board", "date"]).select("symbol", "date", F.round(F.col("r") - F.col("peer"), 6).alias("relative"))


def w40_maturity_split(spark, sf_dir, parts: int = 4, horizon: int = 10, first: int = 5):
    """Bars by part of the sessions: used, left out as their outcome reaches into the next part, or as they lie in a part's first sessions; all are accounted for."""
    rows = _indexed(spark, sf_dir)
    last = calendar(spark, sf_dir).agg(F.max("session").alias("n"))
    part = lambda s: F.floor((s - 1) * parts / F.col("n"))
    rows = rows.crossJoin(F.broadcast(last)).select(  # one row
        part(F.col("session")).alias("part"), part(F.least(F.col("session") + horizon, F.col("n"))).alias("end_part"), part(F.greatest(F.col("session") - first, F.lit(1))).alias("start_part"),
        (F.col("session") + horizon > F.col("n")).alias("open"),
    )
    why = F.when(F.col("open"), "immature").when(F.col("part") != F.col("end_part"), "maturity_gap").when((F.col("part") > 0) & (F.col("part") != F.col("start_part")), "first_sessions").otherwise("used")
    return rows.groupBy("part").agg(*(F.count_if(why == x).alias(x) for x in ("used", "maturity_gap", "first_sessions", "immature")), F.count("*").alias("bars"))


def w48_continuous(spark, sf_dir):
    """Whether the last 21 bars have positive prices and lie on 21 sessions in a row."""
    by = Window.partitionBy("symbol").orderBy("session")
    rows = _indexed(spark, sf_dir)
    ok = (F.min((F.least("open", "high", "low", "close") > 0).cast("int")).over(by.rowsBetween(-20, 0)) == 1) & (F.col("session") - F.lag("session", 20).over(by) == 20)
    return rows.select("symbol", "date", F.coalesce(ok, F.lit(False)).alias("reliable"))


def w51_span(spark, sf_dir):
    """Sessions missing between each bar and the 20th before it."""
    by = Window.partitionBy("symbol").orderBy("session")
    rows = _indexed(spark, sf_dir).withColumn("i", F.row_number().over(by))
    missing = F.col("session") - F.lag("session", 20).over(by) - 20
    return rows.withColumn("missing", missing).filter("missing IS NOT NULL").select("symbol", "date", "missing")


def p26_eligibility(spark, sf_dir):
    """Bars fit as structure input: verified, ranged, and without a later-dated label (an odd line count here)."""
    why = C.reasons(unverified=F.col("verified") == 0, no_range=F.col("high") == F.col("low"), future_metadata=F.col("n_lines") % 5 == 4)
    rows = bars_daily(spark, sf_dir).withColumn("reasons", F.array_join(why, ","))
    return rows.groupBy("reasons").agg(F.count("*").alias("n"))


_B, _BC, _S = sql.with_(sql.BARS), sql.with_(sql.BARS, sql.CALENDAR), sql.with_(sql.SIGNALS)
_IDX = ", x AS (SELECT * FROM bars JOIN calendar USING (date))"
ORACLE = {
    "p04_validate_daily": _B[:-1] + """, p AS (SELECT symbol, count(*) AS n, count(*) FILTER (date IS NULL) AS bd, count(*) FILTER (close IS NULL) AS np, count(*) FILTER (least(open, high, low, close) <= 0) AS bp, count(*) FILTER (high < greatest(open, close, low)) AS hb,
  count(*) FILTER (low > least(open, close, high)) AS la, count(*) FILTER (volume < 0) AS ng, count(date) - count(DISTINCT date) AS dd FROM bars GROUP BY symbol),
i AS (SELECT s_suppkey AS symbol, coalesce(n, 0) AS n_rows, concat_ws(',', CASE WHEN n IS NULL THEN 'empty' END, CASE WHEN n < 60 THEN 'too_few_rows' END, CASE WHEN bd > 0 THEN 'bad_date' END, CASE WHEN np > 0 THEN 'missing_price' END,
  CASE WHEN bp > 0 THEN 'ohlc_non_positive' END, CASE WHEN hb > 0 THEN 'high_below_ohlc' END, CASE WHEN la > 0 THEN 'low_above_ohlc' END, CASE WHEN ng > 0 THEN 'negative_volume' END, CASE WHEN dd > 0 THEN 'duplicate_dates' END) AS issues FROM supplier LEFT JOIN p ON s_suppkey = symbol)
SELECT symbol, n_rows AS rows, issues, issues = '' AS ok FROM i""",
    "p08_external_history": _S + "SELECT symbol, CAST(available_at AS DATE) AS date, arg_max(value, event_id) AS close, max(value) AS high, min(value) AS low FROM signals WHERE value > 0 GROUP BY 1, 2",
    "p10_industry_code": "SELECT code, code[1] AS l1, code[1:3] AS l2, code[4:] AS name FROM (SELECT chr(CAST(65 + n_regionkey AS INTEGER)) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || n_name AS code FROM nation)",
    "p13_finite": _B + "SELECT symbol, count(*) FILTER (n_lines > 1) AS known, count(*) FILTER (n_lines = 1) AS scrubbed FROM bars GROUP BY symbol",
    "p15_filter_page": "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 10 OFFSET 10",
    "p16_search": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')",
    "p18_row_class": "SELECT doc_id, CASE WHEN quality IS NULL THEN 'unavailable' WHEN n_chars < 200 THEN 'deferred' WHEN toxic = 1 THEN 'failed' ELSE 'valid' END AS klass, concat_ws(',', CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM documents LEFT JOIN labels USING (doc_id)",
    "p21_tick": "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)) * CAST('1.001' AS DECIMAL(5,3)), 2) AS DOUBLE) AS price FROM part",
    "p25_point_in_time": _S + "SELECT event_id, CASE WHEN strftime(available_at, '%H:%M:%S') <= '15:00:00' THEN value END AS value FROM signals",
    "p27_forecast_gate": "SELECT vec_id, round(up, 6) AS up, concat_ws(',', CASE WHEN round(mean, 6) < 0 THEN 'low_mean' END, CASE WHEN up < 0.5 THEN 'few_up' END) AS reasons FROM (SELECT vec_id, avg(x) AS mean, avg(CAST(x > 0 AS INT)) AS up FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)",
    "p29_drill_down": _S + "SELECT symbol, CAST(available_at AS DATE) AS day, CAST(count(*) AS INTEGER) AS n, coalesce(string_agg(CASE WHEN side = 'BUY' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS buys, coalesce(string_agg(CASE WHEN side = 'SELL' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS sells FROM signals GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase' AND value > 90)",
    "j04_profile_as_of": _B + "SELECT symbol, last_day(date) AS month_end, max(date) AS seen, arg_max(close, date) AS close FROM bars GROUP BY 1, 2",
    "j15_snapshot_compare": """WITH r AS (SELECT o.c_mktsegment AS old, CASE WHEN n.seg IS NULL THEN 'dropped' WHEN second <> n.seg THEN 'conflict' WHEN n.seg <> o.c_mktsegment THEN 'changed' ELSE 'kept' END AS state FROM customer o LEFT JOIN
  (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' END AS second FROM customer WHERE c_custkey % 7 <> 0) n ON o.c_custkey = n.c_custkey),
c AS (SELECT old, avg(CAST(state <> 'dropped' AS INT)) AS coverage FROM r GROUP BY old)
SELECT old, state, count(*) AS n, round(any_value(coverage), 6) AS coverage, CASE WHEN any_value(coverage) < 0.8 THEN 'refused' ELSE 'applied' END AS verdict FROM r JOIN c USING (old) GROUP BY old, state""",
    "k05_latest_date": "SELECT CAST(max(l_shipdate) AS DATE) AS last FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'",
    "a16_ranking_eligibility": "SELECT source, count(*) AS n, count(quality) AS known, count(quality) >= 5 AND count(quality) * 5 >= count(*) * 4 AS eligible FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "a32_paired_difference": _B + "SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(stddev_samp(a - b), 6) AS sd, round(sum(ln(1 + a) - ln(1 + b)), 5) AS log_growth, round(sqrt(252.0) * (avg(a) / stddev_samp(a) - avg(b) / stddev_samp(b)), 5) AS sharpe FROM (SELECT date, avg(CASE WHEN symbol % 2 = 0 THEN close / open - 1 END) AS a, avg(CASE WHEN symbol % 2 = 1 THEN close / open - 1 END) AS b FROM bars GROUP BY date) WHERE a IS NOT NULL AND b IS NOT NULL",
    "u02_by_name": "SELECT segment, count(*) AS n, count(balance) AS known FROM (SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer) GROUP BY segment",
    "u06_pool": "SELECT p_partkey, p_brand, supplier FROM part LEFT JOIN (SELECT l_partkey, max(l_suppkey) AS supplier FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE p_size > 45 OR p_brand = 'Brand#3'",
    "s07_read_many": _S + "SELECT symbol, CAST(available_at AS DATE) AS date, arg_max(value, (available_at, event_id)) AS close FROM signals WHERE symbol % 10 = 0 AND symbol < 150 GROUP BY 1, 2",
    "w26_dependency": _BC[:-1] + _IDX + ", d AS (SELECT symbol, date, session - lag(session, 64) OVER w AS span, CAST(sum(1 - verified) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 64 PRECEDING AND CURRENT ROW) AS BIGINT) AS bad FROM x WINDOW w AS (PARTITION BY symbol ORDER BY session)) SELECT symbol, date, span, bad, coalesce(span = 64 AND bad = 0, false) AS complete FROM d",
    "w29_interval_return": sql.with_(sql.BARS, sql.INDUSTRY)[:-1] + ", o AS (SELECT symbol, date, board, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars JOIN industry USING (symbol)) SELECT symbol, date, round(r - avg(r) OVER (PARTITION BY board, date), 6) AS relative FROM o",
    "w40_maturity_split": _BC[:-1] + """, n AS (SELECT max(session) AS n FROM calendar), p AS (SELECT CAST(floor((session - 1) * 4 / n) AS BIGINT) AS part, CAST(floor((least(session + 10, n) - 1) * 4 / n) AS BIGINT) AS e, CAST(floor((greatest(session - 5, 1) - 1) * 4 / n) AS BIGINT) AS s, session + 10 > n AS o FROM bars JOIN calendar USING (date), n),
w AS (SELECT part, CASE WHEN o THEN 'immature' WHEN part <> e THEN 'maturity_gap' WHEN part > 0 AND part <> s THEN 'first_sessions' ELSE 'used' END AS why FROM p)
SELECT part, count(*) FILTER (why = 'used') AS used, count(*) FILTER (why = 'maturity_gap') AS maturity_gap, count(*) FILTER (why = 'first_sessions') AS first_sessions, count(*) FILTER (why = 'immature') AS immature, count(*) AS bars FROM w GROUP BY part""",
    "w48_continuous": _BC[:-1] + _IDX + " SELECT symbol, date, coalesce(min(CAST(least(open, high, low, close) > 0 AS INT)) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 1 AND session - lag(session, 20) OVER (PARTITION BY symbol ORDER BY session) = 20, false) AS reliable FROM x",
    "w51_span": _BC[:-1] + _IDX + " SELECT * FROM (SELECT symbol, date, session - lag(session, 20) OVER (PARTITION BY symbol ORDER BY session) - 20 AS missing FROM x) WHERE missing IS NOT NULL",
    "p26_eligibility": _B + "SELECT concat_ws(',', CASE WHEN verified = 0 THEN 'unverified' END, CASE WHEN high = low THEN 'no_range' END, CASE WHEN n_lines % 5 = 4 THEN 'future_metadata' END) AS reasons, count(*) AS n FROM bars GROUP BY 1",
    "p09_availability": sql.with_(sql.CALENDAR) + "SELECT date, CAST(timezone('UTC', timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 16 HOURS)) AS TIMESTAMP) AS available FROM calendar",
}
QUERIES = {name: globals()[name] for name in ORACLE} | {"a32_paired_bootstrap": a32_paired_bootstrap}
