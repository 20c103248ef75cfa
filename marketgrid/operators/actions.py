"""Corporate actions: terms checked, factors dated, prices and indicators adjusted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import sql
from ..sources.tables import bars_daily, calendar, table

#: Days of a bucket of :func:`interval_join`: most spans reach into one or two.
BUCKET_DAYS = 32
#: What is added before levels are rounded, so that halves go up whatever their last bit.
HALF = 1e-7


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, days: int = BUCKET_DAYS) -> DataFrame:
    """Pairs of a point and a span of the same keys with ``low`` < ``at`` <= ``high`` (dates).

    Spans go to every bucket of days that they reach into, points to the one that they lie in, so
    the join is on keys and bucket and either side may be large; a pair meets once.
    """
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)
    reach = F.explode(F.sequence(bucket(F.date_add(F.col(low), 1)), bucket(F.col(high))))
    spread = spans.filter(F.col(low) < F.col(high)).withColumn("__bucket", reach)
    placed = points.withColumn("__bucket", bucket(F.col(at)))
    return placed.join(spread, [*keys, "__bucket"]).filter((F.col(low) < F.col(at)) & (F.col(at) <= F.col(high))).drop("__bucket")


def declared(spark, sf_dir) -> DataFrame:
    """Declared actions: the largest lines stand for them, their discount and tax for cash, bonus shares and withholding."""
    line = F.col("l_linenumber").cast("int")
    day = F.col("l_shipdate").cast("date")
    ex = F.date_add(day, line - 1)
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"), F.col("l_suppkey").alias("symbol"), F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("source_id"),
        day.alias("record_date"), ex.alias("ex_date"), F.date_add(day, 1 - (F.col("l_partkey") % 4).cast("int")).alias("available"), F.round(F.col("l_discount") * 500, 2).alias("cash"),
        F.when(F.col("l_partkey") % 2 == 0, F.round(1 + F.col("l_tax") * 5, 2)).otherwise(1.0).alias("multiplier"), F.round(F.col("l_tax") * 300, 2).alias("tax"),
        F.date_add(ex, (F.col("l_suppkey") % 5).cast("int") - 1).alias("pay_date"), F.when(F.col("l_discount") == 0.1, 0.9).alias("price_factor"), F.col("l_extendedprice").alias("tie"),
    )


def normalised(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """``reasons`` why an action's terms are refused; none if it is good.

    An action needs a source, terms known by its record date, a record date before the ex date, no
    negative cash or fewer shares, a withholding within the cash, no payment before the ex date, and, if it
    gives shares, no session between record and ex date.  Of rows with one id only the first counts.
    """
    rights = actions.filter("multiplier > 1").select("action_id", "record_date", F.date_sub("ex_date", 1).alias("before_ex")).distinct()
    between = interval_join(sessions.select(F.col("date").alias("session_date")), rights, [], "session_date", "record_date", "before_ex")
    between = between.groupBy("action_id", "record_date", "before_ex").agg(F.count("*").alias("between"))
    first = Window.partitionBy("action_id").orderBy("record_date", "symbol", "tie")
    rows = actions.withColumn("nth", F.row_number().over(first)).withColumn("before_ex", F.date_sub("ex_date", 1))
    rows = rows.join(between, ["action_id", "record_date", "before_ex"], "left")
    why = C.reasons(
        repeated_id=F.col("nth") > 1, no_source=F.col("source_id").isNull(), record_not_before_ex=F.col("record_date") >= F.col("ex_date"), terms_known_late=F.col("available") > F.col("record_date"),
        negative_terms=(F.col("cash") < 0) | (F.col("multiplier") < 1), bad_tax=(F.col("cash") > 0) & ~F.col("tax").between(0.0, F.col("cash")),
        pays_before_ex=(F.col("cash") > 0) & (F.col("pay_date") < F.col("ex_date")), detached_rights=(F.col("multiplier") > 1) & (F.col("between") > 0), bad_factor=F.col("price_factor") <= 0,
    )
    return rows.withColumn("reasons", why).drop("nth", "before_ex", "between", "tie")


def factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, date, log_price, log_shares) of the bars at which actions take effect: the first at or after the ex date.

    The price factor is the given one, or what is left of the close before it after the cash, divided
    by the shares for one.  An action before a symbol's first bar, or one whose cash the close before
    does not cover, changes nothing.
    """
    by = Window.partitionBy("symbol").orderBy("date")
    spans = bars.select("symbol", "date", F.lag("date").over(by).alias("date_before"), F.lag("close").over(by).alias("close_before")).filter("date_before IS NOT NULL")
    met = interval_join(actions, spans, ["symbol"], "ex_date", "date_before", "date")
    left = F.when(F.col("close_before") > F.col("cash"), (F.col("close_before") - F.col("cash")) / F.col("close_before") / F.col("multiplier"))
    met = met.withColumn("factor", F.coalesce("price_factor", left)).filter("factor IS NOT NULL")
    return met.groupBy("symbol", "date").agg(F.sum(F.log("factor")).alias("log_price"), F.sum(F.log("multiplier")).alias("log_shares"))


def adjusted(bars: DataFrame, by_bar: DataFrame, average: int = 20, ranges: int = 14) -> DataFrame:
    """Bars with prices and volumes in terms of the last bar, and indicators in terms of their own day.

    ``base`` prices are free of all factors up to their day, so windows over them need no look at
    later actions; a level in terms of day t is the base level times the factors up to t.
    """
    by = Window.partitionBy("symbol").orderBy("date")
    so_far, whole = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol")
    known = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    rows = bars.join(by_bar, ["symbol", "date"], "left").withColumns({"log_price": known("log_price"), "log_shares": known("log_shares")})
    rows = rows.withColumns({"price_to": F.sum("log_price").over(so_far), "shares_to": F.sum("log_shares").over(so_far)})
    rows = rows.withColumns({"price_all": F.sum("log_price").over(whole), "shares_all": F.sum("log_shares").over(whole)})
    rows = rows.withColumns({f"base_{x}": F.col(x) * F.exp(-F.col("price_to")) for x in ("high", "low", "close")})
    before = F.lag("base_close").over(by)
    rows = rows.withColumn("range", F.greatest(F.col("base_high") - F.col("base_low"), F.abs(F.col("base_high") - before), F.abs(F.col("base_low") - before)))
    full = lambda x, n: F.when(F.count(x).over(by.rowsBetween(1 - n, 0)) == n, F.avg(x).over(by.rowsBetween(1 - n, 0)))
    amounts = by.rowsBetween(-20, -1)
    rows = rows.withColumns({
        "ma": full("base_close", average), "atr": full("range", ranges), "close_before": F.lag("close").over(by) * F.exp("log_price"),
        "volume_before": F.lag("volume").over(by) * F.exp("log_shares"), "amount20": F.when(F.count("amount").over(amounts) >= 5, F.avg("amount").over(amounts)),
    })
    now = lambda x: x * F.exp("price_to")
    last = F.exp(F.col("price_all") - F.col("price_to"))
    levels = {f"adj_{x}": F.col(x) * last for x in ("open", "high", "low", "close")} | {
        "adj_volume": F.col("volume") * F.exp(F.col("shares_all") - F.col("shares_to")), "ma": now(F.col("ma")), "ma_before": now(F.lag("ma").over(by)), "atr": now(F.col("atr")),
        "close_before": F.col("close_before"), "volume_before": F.col("volume_before"), "amount20": F.col("amount20"),
    }
    ratios = {"ma_bias": F.col("base_close") / F.col("ma") - 1, "ma_slope5": F.col("ma") / F.lag("ma", 5).over(by) - 1, "atr_ratio": F.col("atr") / F.col("base_close")}
    return rows.select("symbol", "date", *(F.round(x + HALF, 3).alias(n) for n, x in levels.items()), *(F.round(x, 6).alias(n) for n, x in ratios.items()))


def w32_actions(spark, sf_dir):
    """Declared actions and why their terms are refused, if they are."""
    rows = normalised(declared(spark, sf_dir), calendar(spark, sf_dir))
    return rows.select("action_id", "symbol", "record_date", "ex_date", "cash", "multiplier", F.array_join("reasons", ",").alias("reasons"))


def w32_adjusted(spark, sf_dir):
    """Prices, volumes, averages and ranges adjusted for the good actions."""
    bars = bars_daily(spark, sf_dir)
    good = normalised(declared(spark, sf_dir), calendar(spark, sf_dir)).filter("size(reasons) = 0")
    return adjusted(bars, factors(bars, good))


_ACTIONS = """, declared AS (SELECT l_orderkey * 10 + l_linenumber AS action_id, l_suppkey AS symbol, CASE WHEN l_tax > 0 THEN l_returnflag END AS source_id, CAST(l_shipdate AS DATE) AS record_date,
  CAST(l_shipdate AS DATE) + CAST(l_linenumber - 1 AS INTEGER) AS ex_date, CAST(l_shipdate AS DATE) + CAST(1 - l_partkey % 4 AS INTEGER) AS available, round(l_discount * 500, 2) AS cash,
  CASE WHEN l_partkey % 2 = 0 THEN round(1 + l_tax * 5, 2) ELSE 1.0::DOUBLE END AS multiplier, round(l_tax * 300, 2) AS tax, CAST(l_shipdate AS DATE) + CAST(l_linenumber - 2 + l_suppkey % 5 AS INTEGER) AS pay_date,
  CASE WHEN l_discount = 0.1::DOUBLE THEN 0.9::DOUBLE END AS price_factor, l_extendedprice AS tie FROM lineitem WHERE l_quantity >= 49),
numbered AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY record_date, symbol, tie) AS nth,
  multiplier > 1 AND EXISTS (SELECT 1 FROM calendar c WHERE c.date > record_date AND c.date < ex_date) AS detached FROM declared),
judged AS (SELECT *, concat_ws(',', CASE WHEN nth > 1 THEN 'repeated_id' END, CASE WHEN source_id IS NULL THEN 'no_source' END, CASE WHEN record_date >= ex_date THEN 'record_not_before_ex' END,
  CASE WHEN available > record_date THEN 'terms_known_late' END, CASE WHEN cash < 0 OR multiplier < 1 THEN 'negative_terms' END, CASE WHEN cash > 0 AND NOT tax BETWEEN 0 AND cash THEN 'bad_tax' END,
  CASE WHEN cash > 0 AND pay_date < ex_date THEN 'pays_before_ex' END, CASE WHEN detached THEN 'detached_rights' END, CASE WHEN price_factor <= 0 THEN 'bad_factor' END) AS reasons FROM numbered)
"""
_BC = sql.with_(sql.BARS, sql.CALENDAR)[:-1]
ORACLE = {
    "w32_actions": _BC + _ACTIONS + "SELECT action_id, symbol, record_date, ex_date, cash, multiplier, reasons FROM judged",
    "w32_adjusted": _BC + _ACTIONS + """, spans AS (SELECT symbol, date, lag(date) OVER w AS date_before, lag(close) OVER w AS close_before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
hits AS (SELECT s.symbol, s.date, coalesce(price_factor, CASE WHEN close_before > cash THEN (close_before - cash) / close_before / multiplier END) AS factor, multiplier
  FROM spans s JOIN judged j ON s.symbol = j.symbol AND ex_date > date_before AND ex_date <= s.date WHERE reasons = ''),
f AS (SELECT symbol, date, sum(ln(factor)) AS lp, sum(ln(multiplier)) AS ls FROM hits WHERE factor IS NOT NULL GROUP BY 1, 2),
c AS (SELECT b.*, coalesce(lp, 0) AS lp, coalesce(ls, 0) AS ls, sum(coalesce(lp, 0)) OVER w AS p, sum(coalesce(ls, 0)) OVER w AS s, row_number() OVER w AS i FROM bars b LEFT JOIN f USING (symbol, date) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT *, close * exp(-p) AS bc, high * exp(-p) AS bh, low * exp(-p) AS bl, last(p) OVER u AS pa, last(s) OVER u AS sa FROM c WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, lag(close) OVER w * exp(lp) AS bb, greatest(bh - bl, coalesce(abs(bh - lag(bc) OVER w), 0), coalesce(abs(bl - lag(bc) OVER w), 0)) AS tr, lag(volume) OVER w * exp(ls) AS vb FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT *, CASE WHEN i >= 20 THEN avg(bc) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS mb, CASE WHEN i >= 14 THEN avg(tr) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS ab,
  CASE WHEN i > 5 THEN avg(amount) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS a20 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, round(open * exp(pa - p) + 1e-7, 3) AS adj_open, round(high * exp(pa - p) + 1e-7, 3) AS adj_high, round(low * exp(pa - p) + 1e-7, 3) AS adj_low, round(close * exp(pa - p) + 1e-7, 3) AS adj_close, round(volume * exp(sa - s) + 1e-7, 3) AS adj_volume,
  round(mb * exp(p) + 1e-7, 3) AS ma, round(lag(mb) OVER w * exp(p) + 1e-7, 3) AS ma_before, round(ab * exp(p) + 1e-7, 3) AS atr, round(bb + 1e-7, 3) AS close_before, round(vb + 1e-7, 3) AS volume_before, round(a20 + 1e-7, 3) AS amount20,
  round(bc / mb - 1, 6) AS ma_bias, round(mb / lag(mb, 5) OVER w - 1, 6) AS ma_slope5, round(ab / bc, 6) AS atr_ratio FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
