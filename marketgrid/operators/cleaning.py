"""Cleaning, quality audits and coverage of bars (P01-P13, A01-A07, A36, A43-A47, J07, J08, J12, U*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import sql
from ..sources.tables import bars_daily, calendar, fills, signals, table, trades


def latest_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last by ``order``; one shuffle on the keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def _raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    prefix = F.element_at(F.array(*map(F.lit, ("600", "000", "300", "688", "830", "200"))), (key % 6 + 1).cast("int"))
    digits = F.concat(prefix, F.lpad((key % 1000).cast("string"), 3, "0"))
    style = key % 4
    raw = (
        F.when(style == 0, digits).when(style == 1, F.concat(F.lit("sh."), digits))
        .when(style == 2, F.concat(digits, F.lit(".SZ"))).otherwise(F.concat(F.lit(" x"), key.cast("string")))
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"))


_RAW_SYMBOLS = """raws AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN d WHEN 1 THEN 'sh.' || d WHEN 2 THEN d || '.SZ'
  ELSE ' x' || CAST(s_suppkey AS VARCHAR) END AS raw
  FROM (SELECT s_suppkey, (['600','000','300','688','830','200'])[s_suppkey % 6 + 1] || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS d FROM supplier)),
norm AS (SELECT *, CASE WHEN digits <> '' THEN digits || '.' || CASE WHEN given <> '' THEN given
  WHEN digits[1] IN ('6','9') THEN 'SH' WHEN digits[1] IN ('0','2','3') THEN 'SZ' WHEN digits[1] IN ('4','8') THEN 'BJ' END END AS symbol
  FROM (SELECT *, regexp_extract(upper(trim(raw)), '([0-9]{6})', 1) AS digits, regexp_extract(upper(trim(raw)), '(SH|SZ|BJ)', 1) AS given FROM raws))"""


def p01_normalise_symbol(spark, sf_dir):
    return _raw_symbols(spark, sf_dir).select("s_suppkey", "raw", C.normalise_symbol(F.col("raw")).alias("symbol"))


def p02_scope(spark, sf_dir):
    named = p01_normalise_symbol(spark, sf_dir)
    return named.select("s_suppkey", "symbol", C.scope_reason(F.col("symbol")).alias("reason"))


def p11_market_board(spark, sf_dir):
    named = p01_normalise_symbol(spark, sf_dir).filter("symbol IS NOT NULL")
    return named.select("s_suppkey", C.market_board(F.col("symbol")).alias("market_board"))


def p03_clean_daily(spark, sf_dir):
    """The last line of each (symbol, date) with a positive price, values coerced and null rows dropped."""
    rows = trades(spark, sf_dir).dropna(subset=["symbol", "date", "price"]).filter("price > 0")
    kept = latest_wins(rows, ["symbol", "date"], [F.desc("seq")])
    return kept.select("symbol", "date", "price", "quantity")


def p05_normalise_daily(spark, sf_dir):
    """The best of duplicate source rows (verified, then largest) with how many there were."""
    rows = trades(spark, sf_dir).withColumn("copies", F.count("*").over(Window.partitionBy("symbol", "date")))
    rows = rows.withColumn("has_trade_price", (F.col("flag") == "N").cast("int"))
    best = latest_wins(rows, ["symbol", "date"], [F.desc("has_trade_price"), F.desc("notional"), F.desc("seq")])
    return best.select("symbol", "date", "price", "copies", "has_trade_price")


def p06_clean_minute(spark, sf_dir):
    """Minute rows of users: bad values dropped, the last event of a minute kept."""
    rows = signals(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "available_at")).filter("value > 0")
    kept = latest_wins(rows, ["symbol", "minute"], [F.desc("available_at"), F.desc("event_id")])
    return kept.select("symbol", F.col("minute").cast("timestamp_ntz").alias("minute"), "value")


def p07_unit_conversion(spark, sf_dir):
    units = spark.createDataFrame([("A", 100.0, 1000.0), ("N", 1.0, 1.0), ("R", 100.0, 10000.0)], "flag string, lots double, money double")
    rows = table(spark, sf_dir, "lineitem").join(F.broadcast(units), F.col("l_returnflag") == F.col("flag"))  # three rows
    return rows.groupBy("flag").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("lots")), 2).alias("shares"),
        F.round(F.sum(F.round(F.col("l_extendedprice") * F.col("money"), 2)), 0).alias("amount"),
    )


def p14_reason_codes(spark, sf_dir):
    rows = bars_daily(spark, sf_dir)
    codes = C.reasons(
        unverified=F.col("verified") == 0, single_line=F.col("n_lines") == 1, thin=F.col("volume") < 10, flat=F.col("high") == F.col("low")
    )
    return rows.select("symbol", "date", F.array_join(codes, ",").alias("reasons"))


#: Money units of the ledger's amounts.
THOUSAND = 1000.0


def p23_cost_stress(spark, sf_dir):
    """Costs under each stress multiplier: commission and slippage grow, tax doesn't; the multipliers are a fixed short table."""
    stress = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("times")) for n, m in (("base", 1.0), ("double", 2.0), ("severe", 3.5)))))
    rows = fills(spark, sf_dir).select("side", "notional", C.slippage_rate(F.col("notional") * THOUSAND).alias("slippage"), stress.alias("s"))
    cost = C.fee(F.col("side"), F.col("notional"), F.col("s.times")) + F.col("notional") * F.col("slippage") * F.col("s.times")
    return rows.groupBy(F.col("s.scenario").alias("scenario"), "side").agg(F.round(F.sum(cost), 1).alias("cost"))


def p17_direction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a, b = (F.col("n_chars") % 7) / 10.0, (F.col("n_chars") % 3) / 10.0
    return docs.select("doc_id", C.direction(F.round(a, 4), F.round(b, 4), F.round(1 - a - b, 4)).alias("direction"))


def a01_coverage(spark, sf_dir):
    return bars_daily(spark, sf_dir).groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def a02_update_summary(spark, sf_dir):
    return bars_daily(spark, sf_dir).groupBy("symbol").agg(
        F.max("date").alias("last"), F.max((F.col("verified") == 1).cast("int")).alias("has_price"), F.count_if(F.col("volume") > 0).alias("traded")
    )


def a03_table_status(spark, sf_dir):
    return bars_daily(spark, sf_dir).agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"),
        F.count_if(F.col("verified") == 0).alias("unverified"), F.round(F.sum("amount"), 1).alias("amount"),
    )


def a04_quality_gate(spark, sf_dir):
    """Coverage of sessions, invalid share and longest gap of each symbol, head and tail included."""
    days = calendar(spark, sf_dir)
    n = days.agg(F.max("session").alias("sessions"))
    rows = bars_daily(spark, sf_dir).join(days, "date")
    gap = F.col("session") - F.lag("session", 1, 0).over(Window.partitionBy("symbol").orderBy("session")) - 1
    per = rows.withColumn("gap", gap).groupBy("symbol").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("verified") == 0).cast("double")), 6).alias("invalid"),
        F.max("gap").alias("gap"), F.max("session").alias("last"),
    )
    out = per.crossJoin(F.broadcast(n))  # one row
    return out.select(
        "symbol", F.round(F.col("n") / F.col("sessions"), 6).alias("coverage"), "invalid",
        F.greatest("gap", F.col("sessions") - F.col("last")).alias("longest_gap"),
    )


#: Least volume without a warning, largest daily move without one, bars that make a symbol count for the calendar.
MIN_VOLUME, MAX_GAP, CALENDAR_ROWS = 100, 0.15, 3
#: Calendar days behind the end from which a late last bar is a warning.
LATE_DAYS = 5


def a05_issues(spark, sf_dir):
    """Issues of each listed symbol by category and severity, with how many rows or days show them.

    Missing data, invalid prices, repeated rows of a day, negative and low volume, special-treatment
    names, an early last bar, sessions of the inferred calendar without a bar, and daily moves beyond
    ``MAX_GAP``.
    """
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    bars = bars_daily(spark, sf_dir).withColumn("before", F.nullif(before, F.lit(0.0)))
    days = bars.join(bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(f"n >= {CALENDAR_ROWS}").select("symbol"), "symbol", "left_semi").select("date").distinct()
    span = days.agg(F.count("*").alias("sessions"), F.max("date").alias("end"))
    prices = F.least("open", "high", "low", "close") <= 0
    bent = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    per = bars.join(days.withColumn("session", F.lit(1)), "date", "left").groupBy("symbol").agg(
        F.count("*").alias("rows"), F.count_if(prices | bent).alias("invalid"), F.count_if(F.col("volume") < 0).alias("negative"),
        F.count_if((F.col("volume") >= 0) & (F.col("volume") < MIN_VOLUME)).alias("low"), F.sum(F.col("n_lines") - 1).alias("again"),
        F.count_if(F.abs(F.col("close") / F.col("before") - 1) > MAX_GAP).alias("gaps"), F.max("date").alias("last"), F.count("session").alias("on_calendar"),
    )
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_name")
    known = listed.join(per, "symbol", "left").crossJoin(F.broadcast(span))  # one row
    late = F.datediff("end", "last")
    found = (
        ("missing_data", "error", F.col("rows").isNull().cast("long")), ("ohlc_invalid", "error", F.col("invalid")), ("duplicate_date", "error", F.col("again")),
        ("volume_invalid", "error", F.col("negative")), ("volume_invalid", "warning", F.col("low")), ("st_flag", "info", F.col("s_name").contains("ST").cast("long")),
        ("delisted", F.when(late > LATE_DAYS, "warning").otherwise("info"), F.greatest(late, F.lit(0)).cast("long")),
        ("missing_trading_day", "warning", F.col("sessions") - F.col("on_calendar")), ("adjustment_gap", "warning", F.col("gaps")),
    )
    issues = F.array(*(F.struct(F.lit(c).alias("category"), (s if not isinstance(s, str) else F.lit(s)).alias("severity"), n.alias("n")) for c, s, n in found))
    return known.select("symbol", F.explode(F.filter(issues, lambda x: x["n"] > 0)).alias("i")).select("symbol", "i.category", "i.severity", "i.n")


def a06_issue_rollup(spark, sf_dir):
    return a05_issues(spark, sf_dir).groupBy("category", "severity").agg(F.count("*").alias("issues"), F.sum("n").alias("n"), F.count_distinct("symbol").alias("symbols"))


def a06_issue_maps(spark, sf_dir):
    """One row: how many symbols were checked and have data, and issue counts as maps by category and by severity."""
    issues, listed = a05_issues(spark, sf_dir), table(spark, sf_dir, "supplier").agg(F.count("*").alias("checked"))

    def counts(name: str) -> DataFrame:
        pairs = issues.groupBy(name).agg(F.count("*").alias("n"))
        return pairs.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n"))))).alias(f"by_{name}"))

    missing = issues.agg(F.count_if(F.col("category") == "missing_data").alias("missing"), F.count("*").alias("issues"))
    return listed.crossJoin(missing).crossJoin(counts("category")).crossJoin(counts("severity"))  # one row each


def a07_recent_audit(spark, sf_dir, bars: int = 60):
    """Audit of each symbol's last bars: counts, bars by where they come from as a map, and whether the last one may be traded, with the reason."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    last = bars_daily(spark, sf_dir).withColumn("back", back).filter(F.col("back") <= bars)
    last = last.withColumn("source", F.when(F.col("verified") == 1, "verified").when(F.col("n_lines") > 1, "merged").otherwise("single"))
    counts = last.groupBy("symbol", "source").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))).alias("sources"))
    newest = lambda x: F.max(F.when(F.col("back") == 1, x))
    per = last.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("verified") == 0).alias("unverified"), F.count_if(F.col("high") == F.col("low")).alias("flat"),
        newest(F.col("verified")).alias("verified_now"), newest((F.col("high") > F.col("low")).cast("int")).alias("moves"),
    )
    why = F.when(F.col("n") < bars, "short_history").when(F.col("verified_now") == 0, "last_unverified").when(F.col("moves") == 0, "last_flat").otherwise("ok")
    return per.join(counts, "symbol").select("symbol", "n", "unverified", "flat", "sources", why.alias("verdict"))


def a43_calendar(spark, sf_dir):
    """Sessions seen by symbols with at least three bars."""
    rows = bars_daily(spark, sf_dir).select("symbol", "date")
    enough = rows.groupBy("symbol").agg(F.count("*").alias("n")).filter("n >= 3").select("symbol")
    return rows.join(enough, "symbol", "left_semi").select("date").distinct()


def a45_latest_date(spark, sf_dir):
    per = bars_daily(spark, sf_dir).filter("verified = 1").groupBy("symbol").agg(F.max("date").alias("last"))
    return per.agg(F.max("last").alias("last"), F.count("*").alias("symbols"))


def j07_gaps(spark, sf_dir):
    """Missing sessions before each bar, from the calendar's index."""
    rows = bars_daily(spark, sf_dir).select("symbol", "date").join(calendar(spark, sf_dir), "date")
    step = F.col("session") - F.lag("session").over(Window.partitionBy("symbol").orderBy("session"))
    return rows.withColumn("step", step).filter("step > 1").select("symbol", "date", (F.col("step") - 1).alias("missing"))


def j08_spine(spark, sf_dir):
    """Symbol x session with missing bars kept, summed per symbol."""
    rows = bars_daily(spark, sf_dir)
    spine = rows.select("symbol").distinct().crossJoin(calendar(spark, sf_dir).select("date"))  # the operator is this product
    return spine.join(rows, ["symbol", "date"], "left").groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.count("close").alias("bars"), F.count_if(F.col("close").isNull()).alias("missing")
    )


def j12_missing_sessions(spark, sf_dir):
    """Sessions after a symbol's first bar that it has no bar for, counted by month."""
    rows = bars_daily(spark, sf_dir).select("symbol", "date")
    first = rows.groupBy("symbol").agg(F.min("date").alias("first"))
    due = first.join(calendar(spark, sf_dir).select("date"), F.col("date") >= F.col("first")).select("symbol", "date")
    return due.join(rows, ["symbol", "date"], "left_anti").groupBy("symbol", F.year("date").alias("year")).agg(F.count("*").alias("missing"))


def u01_union_directory(spark, sf_dir):
    """All symbols of the directory and of observed bars."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return known.union(table(spark, sf_dir, "lineitem").select("l_suppkey")).distinct()


def u03_difference(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(have, "part", "left_anti")


def u04_intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def u05_source_fallback(spark, sf_dir):
    """Bars from the first source that has any for a symbol's day."""
    rows = trades(spark, sf_dir).withColumn("priority", F.when(F.col("flag") == "N", 1).when(F.col("flag") == "A", 2).otherwise(3))
    best = rows.groupBy("symbol", "date").agg(F.min("priority").alias("priority"))
    return rows.join(best, ["symbol", "date", "priority"]).groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("notional"), 1).alias("amount"))


def k02_latest_quotes(spark, sf_dir):
    """Latest quote of each symbol, flagged when it is older than the market's latest day."""
    rows = bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))
    market = rows.agg(F.max("date").alias("market_date"))
    return rows.crossJoin(F.broadcast(market)).select(  # one row
        "symbol", "close", "date", F.when(F.col("date") < F.col("market_date"), "stale").otherwise("current").alias("status")
    )


def k06_last_sessions(spark, sf_dir):
    return calendar(spark, sf_dir).orderBy(F.desc("session")).limit(60).select("date", "session")


def a38_fingerprint(spark, sf_dir):
    """Order-free fingerprint of bars by symbol: the sum of each canonical row's SHA-256 (its first 60 bits)."""
    ticks = lambda x: F.floor(F.col(x) * 100).cast("long").cast("string")
    row = F.concat_ws("|", F.col("symbol").cast("string"), F.col("date").cast("string"), *(ticks(x) for x in ("close", "volume", "amount")), F.col("verified").cast("string"))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return bars_daily(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def a46_funnel(spark, sf_dir):
    """Each bar charged to its first failing gate, and how many fail a gate at all; first charges add up to all bars."""
    gates = {"unverified": "verified = 0", "thin": "volume < 10", "flat": "high = low"}
    fails = F.filter(F.array(*(F.when(F.expr(e), name) for name, e in gates.items())), lambda x: x.isNotNull())
    rows = bars_daily(spark, sf_dir).withColumn("fails", F.when(F.size(fails) > 0, fails).otherwise(F.array(F.lit("eligible"))))
    each = rows.select("symbol", F.posexplode("fails").alias("at", "gate"))
    return each.groupBy("gate").agg(F.count_if(F.col("at") == 0).alias("first"), F.count("*").alias("any"), F.count_distinct("symbol").alias("symbols"))


_B, _BC = sql.with_(sql.BARS), sql.with_(sql.BARS, sql.CALENDAR)
_BEST = "row_number() OVER (PARTITION BY symbol, date ORDER BY {0}s1 DESC, s2 DESC, s3 DESC, s4 DESC)"
_FEE = "greatest(notional * 0.0003::DOUBLE * {0}, 5.0) + CASE WHEN side = 'SELL' THEN notional * 0.0005::DOUBLE ELSE 0 END"
_RATE = "CASE WHEN notional * 1000 <= 20000000 THEN 0.0025::DOUBLE WHEN notional * 1000 <= 50000000 THEN 0.0015::DOUBLE WHEN notional * 1000 <= 200000000 THEN 0.0008::DOUBLE WHEN notional * 1000 <= 1000000000 THEN 0.0005::DOUBLE ELSE 0.0003::DOUBLE END"
_A05 = """, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM bars),
cal AS (SELECT DISTINCT date FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 3)),
per AS (SELECT symbol, count(*) AS n_rows, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid,
  count(*) FILTER (volume < 0) AS negative, count(*) FILTER (volume >= 0 AND volume < 100) AS low, CAST(sum(n_lines - 1) AS BIGINT) AS again, count(*) FILTER (before <> 0 AND abs(close / before - 1) > 0.15) AS gaps,
  max(date) AS last, count(*) FILTER (date IN (SELECT date FROM cal)) AS on_calendar FROM p GROUP BY symbol),
u AS (SELECT s_suppkey AS symbol, s_name, per.* EXCLUDE (symbol), (SELECT count(*) FROM cal) AS sessions, (SELECT max(date) FROM cal) AS fin FROM supplier LEFT JOIN per ON s_suppkey = symbol),
issues AS (SELECT symbol, 'missing_data' AS category, 'error' AS severity, 1::BIGINT AS n FROM u WHERE n_rows IS NULL UNION ALL SELECT symbol, 'ohlc_invalid', 'error', invalid FROM u WHERE invalid > 0
  UNION ALL SELECT symbol, 'duplicate_date', 'error', again FROM u WHERE again > 0 UNION ALL SELECT symbol, 'volume_invalid', 'error', negative FROM u WHERE negative > 0
  UNION ALL SELECT symbol, 'volume_invalid', 'warning', low FROM u WHERE low > 0 UNION ALL SELECT symbol, 'st_flag', 'info', 1 FROM u WHERE contains(s_name, 'ST')
  UNION ALL SELECT symbol, 'delisted', CASE WHEN fin - last > 5 THEN 'warning' ELSE 'info' END, fin - last FROM u WHERE fin > last
  UNION ALL SELECT symbol, 'missing_trading_day', 'warning', sessions - on_calendar FROM u WHERE sessions > on_calendar UNION ALL SELECT symbol, 'adjustment_gap', 'warning', gaps FROM u WHERE gaps > 0)"""
_JSON = "(SELECT '{{' || string_agg('\"' || {0} || '\":' || n, ',' ORDER BY {0}) || '}}' FROM (SELECT {0}, count(*) AS n FROM issues GROUP BY {0})) AS by_{0}"
_TOP = "greatest(d, f, u)"
ORACLE = {
    "p01_normalise_symbol": sql.with_(_RAW_SYMBOLS) + "SELECT s_suppkey, raw, symbol FROM norm",
    "p02_scope": sql.with_(_RAW_SYMBOLS) + """SELECT s_suppkey, symbol, CASE WHEN symbol IS NULL THEN 'invalid'
  WHEN symbol LIKE '%.BJ' THEN 'excluded_exchange' WHEN NOT regexp_matches(symbol, '^(6[0-9]{5}\\.SH|[03][0-9]{5}\\.SZ)$') THEN 'not_a_share' END AS reason FROM norm""",
    "p11_market_board": sql.with_(_RAW_SYMBOLS) + """SELECT s_suppkey, CASE WHEN symbol LIKE '688%' THEN 'STAR' WHEN symbol LIKE '30%' THEN 'ChiNext'
  WHEN symbol LIKE '%.BJ' THEN 'Beijing' WHEN regexp_matches(symbol, '^(60|00)') THEN 'Main' ELSE 'Other' END AS market_board FROM norm WHERE symbol IS NOT NULL""",
    "p03_clean_daily": sql.with_(sql.TRADES) + f"SELECT symbol, date, price, quantity FROM (SELECT *, {_BEST.format('')} AS k FROM trades WHERE price > 0) WHERE k = 1",
    "p05_normalise_daily": sql.with_(sql.TRADES) + f"""SELECT symbol, date, price, copies, has_trade_price FROM (SELECT *, CASE WHEN flag = 'N' THEN 1 ELSE 0 END AS has_trade_price,
  count(*) OVER (PARTITION BY symbol, date) AS copies, {_BEST.format("CASE WHEN flag = 'N' THEN 1 ELSE 0 END DESC, notional DESC, ")} AS k FROM trades) WHERE k = 1""",
    "p06_clean_minute": sql.with_(sql.SIGNALS) + """SELECT symbol, minute, value FROM (SELECT *, date_trunc('minute', available_at) AS minute,
  row_number() OVER (PARTITION BY symbol, date_trunc('minute', available_at) ORDER BY available_at DESC, event_id DESC) AS k FROM signals WHERE value > 0) WHERE k = 1""",
    "p07_unit_conversion": """SELECT flag, round(sum(l_quantity * lots), 2) AS shares, round(sum(round(l_extendedprice * money, 2)), 0) AS amount
FROM lineitem JOIN (VALUES ('A', 100.0::DOUBLE, 1000.0::DOUBLE), ('N', 1.0, 1.0), ('R', 100.0, 10000.0)) u(flag, lots, money) ON l_returnflag = flag GROUP BY flag""",
    "p14_reason_codes": _B + """SELECT symbol, date, concat_ws(',', CASE WHEN verified = 0 THEN 'unverified' END, CASE WHEN n_lines = 1 THEN 'single_line' END,
  CASE WHEN volume < 10 THEN 'thin' END, CASE WHEN high = low THEN 'flat' END) AS reasons FROM bars""",
    "p23_cost_stress": sql.with_(sql.FILLS) + f"SELECT scenario, side, round(sum({_FEE.format('times')} + notional * ({_RATE}) * times), 1) AS cost FROM fills, (VALUES ('base', 1.0::DOUBLE), ('double', 2.0), ('severe', 3.5)) s(scenario, times) GROUP BY scenario, side",
    "p17_direction": f"""SELECT doc_id, CASE WHEN abs(d + f + u - 1) >= 1e-6 OR least(d, f, u) < 0 OR (d = {_TOP})::INT + (f = {_TOP})::INT + (u = {_TOP})::INT > 1 THEN 'WAIT'
  WHEN u = {_TOP} THEN 'BUY' WHEN d = {_TOP} THEN 'SELL' ELSE 'WAIT' END AS direction
FROM (SELECT doc_id, round(a, 4) AS d, round(b, 4) AS f, round(1 - a - b, 4) AS u FROM (SELECT doc_id, (n_chars % 7) / 10.0::DOUBLE AS a, (n_chars % 3) / 10.0::DOUBLE AS b FROM documents))""",
    "a01_coverage": _B + "SELECT symbol, min(date) AS first, max(date) AS last, count(*) AS n FROM bars GROUP BY symbol",
    "a02_update_summary": _B + "SELECT symbol, max(date) AS last, max(verified) AS has_price, count(*) FILTER (volume > 0) AS traded FROM bars GROUP BY symbol",
    "a03_table_status": _B + "SELECT min(date) AS first, max(date) AS last, count(*) AS n, count(DISTINCT symbol) AS symbols, count(*) FILTER (verified = 0) AS unverified, round(sum(amount), 1) AS amount FROM bars",
    "a04_quality_gate": _BC + """SELECT symbol, round(count(*) / max(total), 6) AS coverage, round(avg(CAST(verified = 0 AS INT)), 6) AS invalid, greatest(max(gap), max(total) - max(session)) AS longest_gap
FROM (SELECT *, session - lag(session, 1, 0) OVER (PARTITION BY symbol ORDER BY session) - 1 AS gap, (SELECT max(session) FROM calendar) AS total FROM bars JOIN calendar USING (date)) GROUP BY symbol""",
    "a05_issues": _B[:-1] + _A05 + " SELECT symbol, category, severity, n FROM issues",
    "a06_issue_rollup": _B[:-1] + _A05 + " SELECT category, severity, count(*) AS issues, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT symbol) AS symbols FROM issues GROUP BY 1, 2",
    "a06_issue_maps": _B[:-1] + _A05 + f" SELECT (SELECT count(*) FROM supplier) AS checked, (SELECT count(*) FROM issues WHERE category = 'missing_data') AS missing, (SELECT count(*) FROM issues) AS issues, {_JSON.format('category')}, {_JSON.format('severity')}",
    "a07_recent_audit": _B[:-1] + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars) WHERE back <= 60),
s AS (SELECT symbol, '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' AS sources FROM (SELECT symbol, CASE WHEN verified = 1 THEN 'verified' WHEN n_lines > 1 THEN 'merged' ELSE 'single' END AS source, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY symbol),
p AS (SELECT symbol, count(*) AS n, count(*) FILTER (verified = 0) AS unverified, count(*) FILTER (high = low) AS flat, max(verified) FILTER (back = 1) AS v, bool_or(high > low) FILTER (back = 1) AS m FROM l GROUP BY symbol)
SELECT symbol, n, unverified, flat, sources, CASE WHEN n < 60 THEN 'short_history' WHEN v = 0 THEN 'last_unverified' WHEN NOT m THEN 'last_flat' ELSE 'ok' END AS verdict FROM p JOIN s USING (symbol)""",
    "a43_calendar": _B + "SELECT DISTINCT date FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 3)",
    "a45_latest_date": _B + "SELECT max(last) AS last, count(*) AS symbols FROM (SELECT symbol, max(date) AS last FROM bars WHERE verified = 1 GROUP BY symbol)",
    "j07_gaps": _BC + "SELECT symbol, date, step - 1 AS missing FROM (SELECT symbol, date, session - lag(session) OVER (PARTITION BY symbol ORDER BY session) AS step FROM bars JOIN calendar USING (date)) WHERE step > 1",
    "j08_spine": _BC + "SELECT s.symbol, count(*) AS sessions, count(close) AS bars, count(*) FILTER (close IS NULL) AS missing FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN calendar c LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date GROUP BY s.symbol",
    "j12_missing_sessions": _BC + """SELECT symbol, year(date) AS year, count(*) AS missing FROM (SELECT f.symbol, c.date FROM (SELECT symbol, min(date) AS first FROM bars GROUP BY symbol) f JOIN calendar c ON c.date >= f.first) d
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = d.symbol AND b.date = d.date) GROUP BY symbol, year(date)""",
    "u01_union_directory": "SELECT s_suppkey AS symbol FROM supplier UNION SELECT l_suppkey FROM lineitem",
    "u03_difference": "SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem",
    "u04_intersection": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_mktsegment",
    "u05_source_fallback": sql.with_(sql.TRADES) + """SELECT priority, count(*) AS n, round(sum(notional), 1) AS amount FROM (SELECT *, CASE flag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority,
  min(CASE flag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) OVER (PARTITION BY symbol, date) AS best FROM trades) WHERE priority = best GROUP BY priority""",
    "k02_latest_quotes": _B + "SELECT symbol, arg_max(close, date) AS close, max(date) AS date, CASE WHEN max(date) < (SELECT max(date) FROM bars) THEN 'stale' ELSE 'current' END AS status FROM bars GROUP BY symbol",
    "k06_last_sessions": sql.with_(sql.CALENDAR) + "SELECT date, session FROM calendar ORDER BY session DESC LIMIT 60",
    "a38_fingerprint": _B + "SELECT symbol, count(*) AS n, CAST(sum(CAST('0x' || sha256(concat_ws('|', symbol, date, CAST(floor(close * 100) AS BIGINT), CAST(floor(volume * 100) AS BIGINT), CAST(floor(amount * 100) AS BIGINT), verified))[:15] AS BIGINT)) AS VARCHAR) AS fingerprint FROM bars GROUP BY symbol",
    "a46_funnel": _B + """, g AS (SELECT symbol, unnest(CASE WHEN verified = 0 OR volume < 10 OR high = low THEN list_filter([CASE WHEN verified = 0 THEN 'unverified' END, CASE WHEN volume < 10 THEN 'thin' END, CASE WHEN high = low THEN 'flat' END], lambda x: x IS NOT NULL) ELSE ['eligible'] END) AS gate,
  CASE WHEN verified = 0 THEN 'unverified' WHEN volume < 10 THEN 'thin' WHEN high = low THEN 'flat' ELSE 'eligible' END AS lead FROM bars)
SELECT gate, count(*) FILTER (gate = lead) AS first, count(*) AS "any", count(DISTINCT symbol) AS symbols FROM g GROUP BY gate""".replace("\n, g", ", g"),
}
QUERIES = {name: globals()[name] for name in ORACLE}
