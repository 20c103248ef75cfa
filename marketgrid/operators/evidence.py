"""As-of joins, evidence state, and board membership over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.windows import full, prior, ratio
from ..plans import sql
from ..sources.tables import bars_daily, calendar, fills, industry_of, signals, table, trades
from .sliding import first_breaks
from .trailing import AVERAGES, RETURNS


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the latest right row of its key at or before its time.

    Union and one ordered pass: a single shuffle on the keys, linear in both sides, where a range
    join would grow with their product.  Of right rows at the same time the largest values win.
    """
    data = F.struct(F.col(right_time).alias("at"), *values)
    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__v"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), data.alias("__v"))
    window = Window.partitionBy(*keys).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = b.unionByName(a, allowMissingColumns=True)
    seen = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(window)).filter("__side = 1")
    return seen.select(*left.columns, F.col("__seen.at").alias(f"{right_time}_seen"), *(F.col(f"__seen.{v}").alias(v) for v in values))


def j01_trade_prices(spark, sf_dir):
    """Bars with the price of the largest line of the day, where a verified one exists."""
    best = trades(spark, sf_dir).filter("flag = 'N'").groupBy("symbol", "date").agg(F.max("price").alias("trade_price"))
    return bars_daily(spark, sf_dir).join(best, ["symbol", "date"], "left").select("symbol", "date", "close", "trade_price")


def j03_as_of(spark, sf_dir):
    """Each purchase with the user's latest view before it, unless it is staler than two days."""
    rows = signals(spark, sf_dir)
    left = rows.filter("event_type = 'purchase'").select("symbol", "event_id", "available_at")
    right = rows.filter("event_type = 'view'").select("symbol", F.col("available_at").alias("viewed"), "value")
    out = as_of(left, right, ["symbol"], "available_at", "viewed", ["value"])
    fresh = F.col("viewed_seen") >= F.col("available_at") - F.expr("INTERVAL 2 DAYS")
    return out.select("event_id", "symbol", F.when(fresh, F.col("value")).alias("value"))


def snapshots(spark, sf_dir) -> DataFrame:
    """Orders as snapshots of boards (customers), with the clocks from which each may be seen; those that no good run refers to are none.

    A snapshot is available on its order's date, in force some days before or after, and up to three
    runs refer to it, of which some fail; it counts once the first good one has finished.
    """
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    run = F.explode(F.expr("sequence(0, CAST(o_orderkey % 3 AS int))")).alias("run")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("board"), key.alias("snapshot"), day.alias("available"), F.date_add(day, (key % 7 - 3).cast("int")).alias("effective"), "o_totalprice", run
    )
    good = rows.filter("(snapshot + run) % 4 <> 0").withColumn("finished", F.date_add("available", (F.col("run") * 5 + F.col("snapshot") % 3).cast("int")))
    return good.groupBy("board", "snapshot", "available", "effective", "o_totalprice").agg(F.min("finished").alias("finished"))


def newest_as_of(rows: DataFrame, asked: DataFrame, key: str, visible: Column, order: list[str], at: str) -> DataFrame:
    """For each asked (key, time) the row of the key that ``order`` puts last among those visible by then; null if there is none.

    A row becomes visible at one time and ranks by another, so the last one seen need not win: both
    tables in one order of time, and a running maximum of the rank.  One shuffle on the key, linear.
    """
    rank = F.struct(*order, *(c for c in rows.columns if c not in (*order, key)))
    a = rows.select(key, visible.alias("__t"), F.lit(0).alias("__side"), rank.alias("__rank"))
    b = asked.select("*", F.col(at).alias("__t"), F.lit(1).alias("__side"))
    by = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b, allowMissingColumns=True).withColumn("__best", F.max("__rank").over(by)).filter("__side = 1")
    return seen.select(*asked.columns, *(F.col(f"__best.{c}").alias(c) for c in rows.columns if c != key))


def j05_membership(spark, sf_dir, lag_days: int = 45):
    """Bitemporal membership: for each decision (an order, some days later) its board's newest snapshot of which every clock stands at or before that day."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision"), F.col("o_custkey").alias("board"), F.date_add(F.col("o_orderdate").cast("date"), lag_days - (F.col("o_orderkey") % 60).cast("int")).alias("cutoff"))
    found = newest_as_of(snapshots(spark, sf_dir), asked, "board", F.greatest("available", "effective", "finished"), ["available", "effective", "snapshot"], "cutoff")
    return found.select("decision", "board", "cutoff", "snapshot", "available", "effective", "o_totalprice")


def j06_running_evidence(spark, sf_dir):
    """Signed balance, last levels of each side and their age in seconds as events come in."""
    rows = signals(spark, sf_dir).filter("side IS NOT NULL")
    so_far = Window.partitionBy("symbol").orderBy("available_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    last = lambda side, x: F.last(F.when(F.col("side") == side, F.col(x)), ignorenulls=True).over(so_far)
    age = lambda side: F.floor(F.unix_micros("available_at") / 1_000_000) - F.floor(F.unix_micros(last(side, "available_at")) / 1_000_000)
    return rows.select(
        "event_id", "symbol", F.sum(signed).over(so_far).alias("balance"), last("BUY", "value").alias("support"), last("SELL", "value").alias("resistance"),
        age("BUY").alias("support_age"), age("SELL").alias("resistance_age"),
    )


def j13_market_signal(spark, sf_dir):
    """One market value per date joined to every bar."""
    bars = bars_daily(spark, sf_dir)
    market = bars.groupBy("date").agg(F.round(F.avg("close"), 6).alias("market_close"), F.count("*").alias("n"))
    return bars.join(market, "date").select("symbol", "date", F.round(F.col("close") / F.col("market_close"), 6).alias("relative"))


def j18_effective_rate(spark, sf_dir):
    """Tax rate in force on each fill's date; the dated table is a few rows."""
    rates = spark.createDataFrame([("1900-01-01", "1996-01-01", 0.003), ("1996-01-01", "1998-06-01", 0.001), ("1998-06-01", "9999-01-01", 0.0005)], "a string, b string, rate double")
    rates = rates.select(F.to_date("a").alias("start"), F.to_date("b").alias("stop"), "rate")
    rows = fills(spark, sf_dir).filter("side = 'SELL'")
    joined = rows.join(F.broadcast(rates), (F.col("date") >= F.col("start")) & (F.col("date") < F.col("stop")))
    return joined.select("fill_id", (F.col("notional") * F.col("rate")).alias("tax"))


def j19_effective_session(spark, sf_dir):
    """Events after the close count for the next session; sessions here are the days with events."""
    rows = signals(spark, sf_dir).withColumn("day", F.to_date("available_at"))
    days = rows.select(F.col("day").alias("session")).distinct()
    late = F.date_format("available_at", "HH:mm:ss") > "15:00:00"
    # A sorted pass over days and needs: each need takes the first session at or after it.
    needs = rows.select("event_id", F.when(late, F.date_add("day", 1)).otherwise(F.col("day")).alias("need"))
    distinct = needs.select("need").distinct()
    both = distinct.select("need", F.lit(None).cast("date").alias("session")).unionByName(days.select(F.col("session").alias("need"), "session"))
    after = Window.orderBy(F.desc("need")).rowsBetween(Window.unboundedPreceding, 0)  # one row per day, last day first
    by_day = both.groupBy("need").agg(F.max("session").alias("session")).select("need", F.last("session", ignorenulls=True).over(after).alias("session"))
    return needs.join(by_day, "need").select("event_id", "session")


def j02_decision_plan(spark, sf_dir):
    """Decisions (fills of accounts mapped to symbols) joined to bar-derived columns of their day."""
    rows = fills(spark, sf_dir).withColumn("symbol", F.col("account") % 100)
    bars = bars_daily(spark, sf_dir).select("symbol", "date", "close", "volume")
    return rows.join(bars, ["symbol", "date"], "left").select("fill_id", "symbol", "date", "close", "volume")


def j11_exclusions(spark, sf_dir):
    """Customers without orders, with negative balance, or without an order in the last year of the table, with the reason."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("date"))
    last = orders.groupBy("c_custkey").agg(F.max("date").alias("last")).crossJoin(F.broadcast(orders.agg(F.max("date").alias("end"))))  # one row
    seen = rows.join(last, "c_custkey", "left")
    why = C.reasons(no_orders=F.col("last").isNull(), negative_balance=F.col("c_acctbal") < 0, stale=F.datediff("end", "last") > 365)
    return seen.select("c_custkey", F.explode(why).alias("reason"))


def j14_regime_blend(spark, sf_dir):
    """Own daily return blended with the industry's on matched dates, clipped."""
    own = bars_daily(spark, sf_dir).join(industry_of(spark, sf_dir), "symbol")
    own = own.withColumn("r", F.col("close") / F.col("open") - 1)
    peer = own.groupBy("board", "date").agg(F.avg("r").alias("peer"), F.count("*").alias("n")).filter("n >= 2")
    blended = F.when(F.col("peer").isNotNull(), F.greatest(F.lit(-0.2), F.least(F.lit(0.2), 0.7 * F.col("r") + 0.3 * F.col("peer")))).otherwise(F.col("r"))
    return own.join(peer, ["board", "date"], "left").select("symbol", "date", F.round(blended, 5).alias("blended"))


def j16_field_merge(spark, sf_dir):
    """New non-empty values override old ones, field by field; rows of either side stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    old = docs.filter("doc_id % 3 <> 0 OR doc_id % 2 <> 0")
    new = docs.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.upper("lang")).alias("new_lang"))
    merged = old.join(new, "doc_id", "full")
    return merged.select("doc_id", F.coalesce(F.nullif("new_lang", F.lit("")), "lang").alias("lang"), "source")


def j17_single_class(spark, sf_dir):
    """The event type of a user's day if it has only one; conflicts are unknown."""
    rows = signals(spark, sf_dir).groupBy("symbol", F.to_date("available_at").alias("day")).agg(F.count_distinct("event_type").alias("n"), F.min("event_type").alias("one"))
    return rows.select("symbol", "day", F.when(F.col("n") == 1, F.col("one")).otherwise("unknown").alias("klass"))


def j20_fills_on_bars(spark, sf_dir, cutoff: str = "1999-01-01"):
    rows = fills(spark, sf_dir).filter(F.col("date") <= F.to_date(F.lit(cutoff)))
    days = calendar(spark, sf_dir).select("date")
    return rows.join(days, "date", "left_semi").select("fill_id", "account", "date", "side")


def j21_catalog_merge(spark, sf_dir):
    """Nations matched to a code by a name that is unique on the first provider's side, else on the second's; two that differ are a conflict.

    Providers are suppliers and customers, their codes the single one of a nation.
    """
    def single(name: str, key: str, nation: str, as_: str):
        rows = table(spark, sf_dir, name).groupBy(F.col(nation).alias("n_nationkey")).agg(F.count("*").alias("n"), F.min(key).alias(as_))
        return rows.withColumn(as_, F.when(F.col("n") == 1, F.col(as_))).select("n_nationkey", as_, F.col("n").alias(f"n_{as_}"))

    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    both = nations.join(single("supplier", "s_suppkey", "s_nationkey", "first"), "n_nationkey", "left").join(single("customer", "c_custkey", "c_nationkey", "second"), "n_nationkey", "left")
    state = (
        F.when(F.col("first").isNotNull() & F.col("second").isNotNull() & (F.col("first") != F.col("second")), "conflict").when(F.col("first").isNotNull(), "first")
        .when(F.col("second").isNotNull(), "second").when(F.coalesce("n_first", "n_second").isNull(), "absent").otherwise("ambiguous")
    )
    return both.select("n_name", F.when(state != "conflict", F.coalesce("first", "second")).alias("code"), state.alias("state"))


def closed_bars(bars: DataFrame, period: str) -> DataFrame:
    """Weekly or monthly bars; a bucket is available once a bar of a later one is seen."""
    rows = bars.withColumn("bucket", F.date_trunc(period, "date").cast("date"))
    made = rows.groupBy("symbol", "bucket").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.round(F.sum("volume"), 2).alias("volume"), F.min("date").alias("first"),
    )
    available = F.lead("first").over(Window.partitionBy("symbol").orderBy("bucket"))
    return made.withColumn("available", available).filter("available IS NOT NULL").drop("first")


def w21_weekly(spark, sf_dir):
    return closed_bars(bars_daily(spark, sf_dir), "week").withColumnRenamed("bucket", "week")


def w21_monthly(spark, sf_dir):
    return closed_bars(bars_daily(spark, sf_dir), "month").withColumnRenamed("bucket", "month")


def w22_higher_period(spark, sf_dir):
    """Return of the latest published week as of each day."""
    weekly = w21_weekly(spark, sf_dir)
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("week"))
    weekly = weekly.select("symbol", "available", F.round(F.col("close") / before - 1, 6).alias("week_return"))
    days = bars_daily(spark, sf_dir).select("symbol", "date")
    return as_of(days, weekly, ["symbol"], "date", "available", ["week_return"]).select("symbol", "date", "week_return")


def w33_event_age(spark, sf_dir):
    """Sessions since a user's last purchase and last error; sessions are the days with events."""
    rows = signals(spark, sf_dir).withColumn("day", F.to_date("available_at"))
    days = rows.select("day").distinct().withColumn("session", F.row_number().over(Window.orderBy("day")))  # one row per day
    so_far = Window.partitionBy("symbol").orderBy("available_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(days, "day")
    age = lambda side: F.col("session") - F.last(F.when(F.col("side") == side, F.col("session")), ignorenulls=True).over(so_far)
    return rows.select("event_id", age("BUY").alias("buy_age"), age("SELL").alias("sell_age"))


def w34_first_visible(spark, sf_dir):
    """First time that each (user, type, amount in whole units) was seen."""
    rows = signals(spark, sf_dir).withColumn("original", F.floor("value"))
    return rows.groupBy("symbol", "event_type", "original").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


def w35_first_seen(spark, sf_dir):
    """New parts that a symbol trades on each day."""
    first = trades(spark, sf_dir).groupBy("symbol", "part").agg(F.min("date").alias("date"))
    return first.groupBy("symbol", "date").agg(F.count("*").alias("new_parts"))


def w36_consensus(spark, sf_dir, cap: float = 0.6, min_margin: float = 0.1):
    """Buy and sell evidence of a user from four sources in two families, normalised, with a family's share capped, margin, independence and direction.

    A source is a type of event, its weight the mean value.  No family may give more than ``cap`` of a
    side.  Evidence is independent if both families speak for the side that leads.
    """
    kinds = {"purchase": ("BUY", "trade"), "click": ("BUY", "traffic"), "error": ("SELL", "trade"), "view": ("SELL", "traffic")}
    pick = lambda at: F.coalesce(*(F.when(F.col("event_type") == k, v[at]) for k, v in kinds.items()))
    rows = signals(spark, sf_dir).filter(F.col("event_type").isin(*kinds)).groupBy("symbol", "event_type").agg(F.avg("value").alias("w"))
    rows = rows.select("symbol", pick(0).alias("side"), pick(1).alias("family"), "w")
    side = Window.partitionBy("symbol", "side")
    rows = rows.withColumn("w", F.when(F.count("*").over(side) > 1, F.least(F.col("w"), cap * F.sum("w").over(side))).otherwise(F.col("w")))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("w"))), F.lit(0.0))
    per = rows.groupBy("symbol").agg(
        total("BUY").alias("buy"), total("SELL").alias("sell"), F.count("*").alias("sources"), F.count_if(F.col("side") == "BUY").alias("n_buy"), F.count_if(F.col("side") == "SELL").alias("n_sell")
    )
    margin = (F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0.0))
    leading = F.when(margin > 0, F.col("n_buy")).otherwise(F.col("n_sell"))
    return per.select(
        "symbol", "sources", F.round(margin, 5).alias("margin"), (leading >= 2).alias("independent"),
        F.when(margin > min_margin, "BUY").when(margin < -min_margin, "SELL").otherwise("WAIT").alias("direction"),
    )


def alive_until_break(rows: DataFrame, valid_bars: int, touch: bool = False) -> DataFrame:
    """``alive`` and ``broken_on`` of the rows with a ``side``: bars after it until a close lies beyond ``level``, ``valid_bars`` at most.

    ``rows`` are all bars (symbol, date, close, level, side).  A symbol's bars are one ordered group; any
    number of bars costs one pass, as the next break of each level comes from a stack of lows.
    """

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date").reset_index(drop=True)
        closes, sides, levels = bars.close.tolist(), bars.side.tolist(), bars.level.tolist()
        breaks = {}
        for side, sign in (("BUY", 1.0), ("SELL", -1.0)):
            asked = [sign * level if s == side else None for s, level in zip(sides, levels, strict=True)]
            breaks[side] = first_breaks([sign * c for c in closes], asked, touch)
        out, days = [], bars.date.tolist()
        for k, side in enumerate(sides):
            if side in breaks:
                at, end = breaks[side][k], min(k + valid_bars, len(closes) - 1)
                broke = at is not None and at <= end
                out.append((bars.symbol[0], days[k], side, at - k - 1 if broke else end - k, days[at] if broke else None))
        return pd.DataFrame(out, columns=["symbol", "date", "side", "alive", "broken_on"])

    return rows.groupBy("symbol").applyInPandas(run, "symbol long, date date, side string, alive int, broken_on date")


def w37_validity(spark, sf_dir, valid_bars: int = 120):
    """Breakouts over 20 bars' highs, and under their lows, stay valid for 120 bars unless a close falls back beyond the broken level."""
    before = Window.partitionBy("symbol").orderBy("date").rowsBetween(-20, -1)
    rows = bars_daily(spark, sf_dir).select("symbol", "date", "close", F.max("high").over(before).alias("top"), F.min("low").over(before).alias("bottom"))
    side = F.when(F.col("close") > F.col("top"), "BUY").when(F.col("close") < F.col("bottom"), "SELL")
    rows = rows.withColumn("side", side).withColumn("level", F.when(side == "BUY", F.col("top")).when(side == "SELL", F.col("bottom")))
    return alive_until_break(rows.drop("top", "bottom"), valid_bars)


A17_STAGES = (
    AVERAGES | {"ret_1": RETURNS["ret_1"], "vol_ratio20": ratio("volume", full("avg", "volume", 20, 1)), "top20": full("max", "high", 20, 1)},
    {
        "buy": "CASE WHEN close > ma20 AND ma5 > ma20 AND ret_1 > 0 AND vol_ratio20 >= 1.2 THEN 1 ELSE 0 END",
        "sell": "CASE WHEN close < ma20 AND ret_1 < 0 AND vol_ratio20 >= 1.2 THEN 1 ELSE 0 END",
        "candidate": "CASE WHEN close > top20 THEN 1 ELSE 0 END",
    },
    {"new_candidate": f"CASE WHEN candidate = 1 AND coalesce({prior('candidate')}, 0) = 0 THEN 1 ELSE 0 END"},
)
_A17 = {
    "price_available": "count(close)", "input_available": "count(vol_ratio20)", "failed": "sum(1 - verified)", "direction_buy": "sum(buy)",
    "direction_sell": "sum(sell)", "candidates": "sum(candidate)", "new_candidates": "sum(new_candidate)",
    "risk_blocked": "sum(CASE WHEN candidate = 1 AND verified = 0 THEN 1 ELSE 0 END)", "advancing": "sum(CASE WHEN ret_1 > 0 THEN 1 ELSE 0 END)",
    "above_average": "sum(CASE WHEN close > ma20 THEN 1 ELSE 0 END)", "samples": "count(ret_1)",
}
_A17_LAST = {"mean_return": "round(avg(ret_1), 6)", "mean_volume_ratio": "round(avg(vol_ratio20), 6)"}


def a17_history(spark, sf_dir):
    """Coverage, counters and mean inputs by (date) and (date, industry) in one pass over grouping sets; missing prices against the members."""
    rows, owner = bars_daily(spark, sf_dir), industry_of(spark, sf_dir)
    for stage in A17_STAGES:
        rows = rows.selectExpr("*", *(f"{e} AS {name}" for name, e in stage.items()))
    out = rows.join(owner, "symbol").groupingSets([["date"], ["date", "board"]], "date", "board").agg(
        *(F.expr(e).alias(name) for name, e in (_A17 | _A17_LAST).items())
    )
    sizes = owner.groupBy("board").agg(F.count("*").alias("universe"))
    whole = sizes.agg(F.sum("universe").alias("everyone"))
    sized = out.join(F.broadcast(sizes), "board", "left").crossJoin(F.broadcast(whole))  # a row for each industry; one row
    universe = F.coalesce("universe", "everyone")
    rate = lambda x: F.round(F.col(x) / universe, 6)
    return sized.select(
        "date", "board", universe.alias("universe"), *_A17, (universe - F.col("price_available")).alias("missing_price"), *_A17_LAST,
        rate("direction_buy").alias("buy_rate"), rate("direction_sell").alias("sell_rate"),
    )


def a18_event_types(spark, sf_dir):
    rows = signals(spark, sf_dir)
    return rows.groupBy("event_type").agg(F.count("*").alias("new_total"), F.count_distinct("symbol", F.to_date("available_at")).alias("active_days"))


def k04_page(spark, sf_dir, page: int = 3, size: int = 50):
    """A page of facts, newest first."""
    rows = bars_daily(spark, sf_dir).select("date", "symbol", "close")
    return rows.orderBy(F.desc("date"), "symbol").offset((page - 1) * size).limit(size)


def a14_board_evidence(spark, sf_dir, min_members: int = 5, min_coverage: float = 0.8):
    """By day of events: eligible users, coverage of the day's users, mean scores, four direction ratios, distinct active ids, reason histogram.

    A user is eligible with a purchase or an error that day; its direction follows from which of them
    weighs more.  Ratios and means are null where fewer than ``min_members`` or less than
    ``min_coverage`` of the users are eligible.
    """
    day = F.to_date("available_at").alias("day")
    weight = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("value"))), F.lit(0.0))
    users = signals(spark, sf_dir).groupBy(day, "symbol").agg(
        weight("BUY").alias("buy"), weight("SELL").alias("sell"), F.count("side").alias("known"), F.count_if(F.col("side") == "BUY").alias("buys"),
        F.count_if(F.col("side") == "SELL").alias("sells"),
    )
    direction = (
        F.when(F.col("known") == 0, "none").when((F.col("buys") > 0) & (F.col("sells") > 0) & (F.abs(F.col("buy") - F.col("sell")) < 10), "CONFLICT")
        .when(F.col("buy") > F.col("sell"), "BUY").when(F.col("sell") > F.col("buy"), "SELL").otherwise("ABSTAIN")
    )
    users = users.withColumn("direction", direction)
    reasons = users.groupBy("day", F.when(F.col("known") == 0, "no_evidence").otherwise(F.lower("direction")).alias("reason")).agg(F.count("*").alias("n"))
    histogram = F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n"))))
    reasons = reasons.groupBy("day").agg(F.to_json(histogram).alias("reasons"))
    seen = users.groupBy("day").agg(
        F.count("*").alias("members"), F.count_if(F.col("known") > 0).alias("eligible"),
        *(F.avg(F.when(F.col("known") > 0, F.col(x))).alias(f"mean_{x}") for x in ("buy", "sell")),
        *(F.count_if(F.col("direction") == x.upper()).alias(f"n_{x}") for x in ("buy", "sell", "abstain", "conflict")),
        F.sum("buys").alias("buy_events"), F.sum("sells").alias("sell_events"),
    )
    coverage = F.col("eligible") / F.col("members")
    good = (F.col("eligible") >= min_members) & (coverage >= min_coverage)
    return seen.join(reasons, "day").select(
        "day", "members", "eligible", F.round(coverage, 6).alias("coverage"), *(F.when(good, F.round(f"mean_{x}", 5)).alias(f"mean_{x}") for x in ("buy", "sell")),
        *(F.when(good, F.round(F.col(f"n_{x}") / F.col("eligible"), 6)).alias(f"{x}_ratio") for x in ("buy", "sell", "abstain", "conflict")),
        "buy_events", "sell_events", "reasons",
    )


def a15_method_summary(spark, sf_dir):
    """Status counts, direction ratios, mean and median of sources' documents, each against its own denominator.

    Ratios of direction are of complete rows (labelled and long enough), the forecast's mean and median
    of rows with a length, the score's mean of labelled ones; coverage is of all rows.
    """
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    complete = F.col("quality").isNotNull() & (F.col("n_chars") >= 200)
    status = F.when(complete, "complete").when(F.col("quality").isNull(), "unavailable").otherwise("deferred")
    direction = F.when(complete, F.when(F.col("toxic") == 1, "sell").when(F.col("quality") == 1, "buy").otherwise("wait"))
    per = rows.withColumns({"status": status, "direction": direction}).groupBy("source").agg(
        F.count("*").alias("expected"), *(F.count_if(F.col("status") == x).alias(x) for x in ("complete", "deferred", "unavailable")),
        *(F.count_if(F.col("direction") == x).alias(x) for x in ("buy", "sell", "wait")), F.count("n_chars").alias("forecasts"), F.round(F.avg("n_chars"), 5).alias("mean_chars"),
        F.round(F.percentile("n_chars", F.lit(0.5)), 4).alias("median_chars"), F.count("quality").alias("scores"), F.round(F.avg("quality"), 6).alias("mean_score"),
    )
    share = lambda x, of: F.round(F.col(x) / F.nullif(of, F.lit(0)), 6)
    return per.select(
        "*", *(share(x, "complete").alias(f"{x}_ratio") for x in ("buy", "sell", "wait")), share("complete", "expected").alias("complete_ratio"), share("scores", "expected").alias("score_ratio")
    )


_S = sql.with_(sql.SIGNALS)
_B = sql.with_(sql.BARS)
_WEEK = """weekly AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY date) AS close, round(sum(volume), 2) AS volume, min(date) AS first FROM bars GROUP BY 1, 2),
published AS (SELECT * FROM (SELECT *, lead(first) OVER (PARTITION BY symbol ORDER BY week) AS available FROM weekly) WHERE available IS NOT NULL)"""
_RUN = "OVER (PARTITION BY symbol ORDER BY available_at, event_id ROWS UNBOUNDED PRECEDING)"
_A17_SQL = sql.with_(sql.BARS, sql.INDUSTRY)[:-1] + """, f AS (SELECT *, close / lag(close) OVER s - 1 AS ret_1, CASE WHEN count(close) OVER (s ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (s ROWS 19 PRECEDING) END AS ma20,
  CASE WHEN count(close) OVER (s ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (s ROWS 4 PRECEDING) END AS ma5, CASE WHEN count(volume) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN
  volume / nullif(avg(volume) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) END AS vr, CASE WHEN count(high) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN
  max(high) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS top FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT *, coalesce(close > top, false) AS c, coalesce(lag(close > top) OVER (PARTITION BY symbol ORDER BY date), false) AS c_before FROM f),
h AS (SELECT date, board, count(close) AS price_available, count(vr) AS input_available, CAST(sum(1 - verified) AS BIGINT) AS failed,
  count(*) FILTER (close > ma20 AND ma5 > ma20 AND ret_1 > 0 AND vr >= 1.2) AS direction_buy, count(*) FILTER (close < ma20 AND ret_1 < 0 AND vr >= 1.2) AS direction_sell,
  count(*) FILTER (c) AS candidates, count(*) FILTER (c AND NOT c_before) AS new_candidates, count(*) FILTER (c AND verified = 0) AS risk_blocked,
  count(*) FILTER (ret_1 > 0) AS advancing, count(*) FILTER (close > ma20) AS above_average, count(ret_1) AS samples, round(avg(ret_1), 6) AS mean_return, round(avg(vr), 6) AS mean_volume_ratio
  FROM g JOIN industry USING (symbol) GROUP BY GROUPING SETS ((date), (date, board))),
u AS (SELECT h.*, coalesce(n, (SELECT count(*) FROM industry)) AS universe FROM h LEFT JOIN (SELECT board AS b, count(*) AS n FROM industry GROUP BY board) ON board = b)
SELECT *, universe - price_available AS missing_price, round(direction_buy / universe, 6) AS buy_rate, round(direction_sell / universe, 6) AS sell_rate FROM u"""
ORACLE = {
    "j01_trade_prices": _B + "SELECT b.symbol, b.date, close, trade_price FROM bars b LEFT JOIN (SELECT symbol, date, max(price) AS trade_price FROM trades WHERE flag = 'N' GROUP BY symbol, date) USING (symbol, date)",
    "j03_as_of": _S + """SELECT event_id, symbol, CASE WHEN viewed >= available_at - INTERVAL 2 DAYS THEN value END AS value
FROM (SELECT p.event_id, p.symbol, p.available_at, v.available_at AS viewed, v.value FROM (SELECT * FROM signals WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM signals WHERE event_type = 'view') v ON p.symbol = v.symbol AND p.available_at >= v.available_at)""",
    "j05_membership": """WITH s AS (SELECT o_custkey AS board, o_orderkey AS snapshot, CAST(o_orderdate AS DATE) AS available, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 - 3 AS INTEGER) AS effective, o_totalprice,
  CAST(o_orderdate AS DATE) + CAST(run * 5 + o_orderkey % 3 AS INTEGER) AS finished FROM orders, range(3) r(run) WHERE run <= o_orderkey % 3 AND (o_orderkey + run) % 4 <> 0),
d AS (SELECT o_orderkey AS decision, o_custkey AS board, CAST(o_orderdate AS DATE) + CAST(45 - o_orderkey % 60 AS INTEGER) AS cutoff FROM orders),
m AS (SELECT decision, d.board, cutoff, snapshot, available, effective, o_totalprice, row_number() OVER (PARTITION BY decision, d.board, cutoff ORDER BY available DESC NULLS LAST, effective DESC, snapshot DESC) AS nth
  FROM d LEFT JOIN s ON s.board = d.board AND available <= cutoff AND effective <= cutoff AND finished <= cutoff)
SELECT decision, board, cutoff, snapshot, available, effective, o_totalprice FROM m WHERE nth = 1""",
    "j06_running_evidence": _S + f"""SELECT event_id, symbol, balance, support, resistance, CAST(floor(epoch_us(available_at) / 1000000) - floor(epoch_us(buy_at) / 1000000) AS BIGINT) AS support_age, CAST(floor(epoch_us(available_at) / 1000000) - floor(epoch_us(sell_at) / 1000000) AS BIGINT) AS resistance_age
FROM (SELECT event_id, symbol, available_at, CAST(sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) {_RUN} AS BIGINT) AS balance, last_value(CASE WHEN side = 'BUY' THEN value END IGNORE NULLS) {_RUN} AS support, last_value(CASE WHEN side = 'SELL' THEN value END IGNORE NULLS) {_RUN} AS resistance,
  last_value(CASE WHEN side = 'BUY' THEN available_at END IGNORE NULLS) {_RUN} AS buy_at, last_value(CASE WHEN side = 'SELL' THEN available_at END IGNORE NULLS) {_RUN} AS sell_at FROM signals WHERE side IS NOT NULL)""",
    "j13_market_signal": _B + "SELECT symbol, b.date, round(close / market_close, 6) AS relative FROM bars b JOIN (SELECT date, round(avg(close), 6) AS market_close FROM bars GROUP BY date) m ON b.date = m.date",
    "j18_effective_rate": sql.with_(sql.FILLS) + "SELECT fill_id, notional * CASE WHEN date < DATE '1996-01-01' THEN 0.003::DOUBLE WHEN date < DATE '1998-06-01' THEN 0.001::DOUBLE ELSE 0.0005::DOUBLE END AS tax FROM fills WHERE side = 'SELL'",
    "j19_effective_session": _S + """SELECT event_id, (SELECT min(CAST(d.available_at AS DATE)) FROM signals d WHERE CAST(d.available_at AS DATE) >= need) AS session
FROM (SELECT event_id, CAST(available_at AS DATE) + CASE WHEN strftime(available_at, '%H:%M:%S') > '15:00:00' THEN 1 ELSE 0 END AS need FROM signals)""",
    "j02_decision_plan": sql.with_(sql.BARS, sql.FILLS) + "SELECT fill_id, account % 100 AS symbol, f.date, close, volume FROM fills f LEFT JOIN bars b ON b.symbol = f.account % 100 AND b.date = f.date",
    "j11_exclusions": """WITH s AS (SELECT c_custkey, c_acctbal, max(CAST(o_orderdate AS DATE)) AS last, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS fin FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey, 'no_orders' AS reason FROM s WHERE last IS NULL UNION ALL SELECT c_custkey, 'negative_balance' FROM s WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'stale' FROM s WHERE fin - last > 365""",
    "j14_regime_blend": sql.with_(sql.BARS, sql.INDUSTRY) + """, own AS (SELECT symbol, date, board, close / open - 1 AS r FROM bars JOIN industry USING (symbol)),
peer AS (SELECT board, date, avg(r) AS peer FROM own GROUP BY board, date HAVING count(*) >= 2)
SELECT symbol, date, round(CASE WHEN peer IS NOT NULL THEN greatest(-0.2, least(0.2, 0.7 * r + 0.3 * peer)) ELSE r END, 5) AS blended FROM own LEFT JOIN peer USING (board, date)""",
    "j16_field_merge": "SELECT doc_id, coalesce(nullif(new_lang, ''), lang) AS lang, source FROM (SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0) FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE upper(lang) END AS new_lang FROM documents WHERE doc_id % 2 = 0) USING (doc_id)",
    "j17_single_class": _S + "SELECT symbol, CAST(available_at AS DATE) AS day, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'unknown' END AS klass FROM signals GROUP BY 1, 2",
    "j20_fills_on_bars": sql.with_(sql.FILLS, sql.CALENDAR) + "SELECT fill_id, account, date, side FROM fills WHERE date <= DATE '1999-01-01' AND date IN (SELECT date FROM calendar)",
    "j21_catalog_merge": """WITH f AS (SELECT s_nationkey AS k, count(*) AS n, CASE WHEN count(*) = 1 THEN min(s_suppkey) END AS code FROM supplier GROUP BY 1), s AS (SELECT c_nationkey AS k, count(*) AS n, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS code FROM customer GROUP BY 1),
b AS (SELECT n_name, f.code AS a, s.code AS b, coalesce(f.n, s.n) AS n FROM nation LEFT JOIN f ON f.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey)
SELECT n_name, CASE WHEN a <> b THEN NULL ELSE coalesce(a, b) END AS code, CASE WHEN a <> b THEN 'conflict' WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' WHEN n IS NULL THEN 'absent' ELSE 'ambiguous' END AS state FROM b""",
    "w21_weekly": sql.with_(sql.BARS, _WEEK) + "SELECT symbol, week, open, high, low, close, volume, available FROM published",
    "w21_monthly": sql.with_(sql.BARS, _WEEK.replace("week", "month")) + "SELECT symbol, month, open, high, low, close, volume, available FROM published",
    "w22_higher_period": sql.with_(sql.BARS, _WEEK) + """, r AS (SELECT symbol, available, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY week) - 1, 6) AS week_return FROM published)
SELECT b.symbol, b.date, week_return FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.date >= r.available""",
    "w33_event_age": _S[:-1] + f", n AS (SELECT *, dense_rank() OVER (ORDER BY CAST(available_at AS DATE)) AS i FROM signals) SELECT event_id, i - last_value(CASE WHEN side = 'BUY' THEN i END IGNORE NULLS) {_RUN} AS buy_age, i - last_value(CASE WHEN side = 'SELL' THEN i END IGNORE NULLS) {_RUN} AS sell_age FROM n",
    "w34_first_visible": _S + "SELECT symbol, event_type, CAST(floor(value) AS BIGINT) AS original, min(event_id) AS event_id, count(*) AS n FROM signals GROUP BY 1, 2, 3",
    "w35_first_seen": sql.with_(sql.TRADES) + "SELECT symbol, date, count(*) AS new_parts FROM (SELECT symbol, part, min(date) AS date FROM trades GROUP BY symbol, part) GROUP BY symbol, date",
    "w36_consensus": _S[:-1] + """, s AS (SELECT symbol, CASE WHEN event_type IN ('purchase', 'click') THEN 'BUY' ELSE 'SELL' END AS side, avg(value) AS w FROM signals WHERE event_type IN ('purchase', 'click', 'error', 'view') GROUP BY symbol, event_type),
c AS (SELECT symbol, side, CASE WHEN count(*) OVER (PARTITION BY symbol, side) > 1 THEN least(w, 0.6::DOUBLE * sum(w) OVER (PARTITION BY symbol, side)) ELSE w END AS w FROM s),
t AS (SELECT symbol, count(*) AS sources, coalesce(sum(w) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(w) FILTER (side = 'SELL'), 0) AS sell, count(*) FILTER (side = 'BUY') AS nb, count(*) FILTER (side = 'SELL') AS ns FROM c GROUP BY symbol),
m AS (SELECT *, (buy - sell) / nullif(buy + sell, 0) AS m FROM t)
SELECT symbol, sources, round(m, 5) AS margin, CASE WHEN m > 0 THEN nb >= 2 ELSE ns >= 2 END AS independent, CASE WHEN m > 0.1 THEN 'BUY' WHEN m < -0.1 THEN 'SELL' ELSE 'WAIT' END AS direction FROM m""",
    "w37_validity": _B + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, max(high) OVER w AS top, min(low) OVER w AS bottom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN close > top THEN 'BUY' ELSE 'SELL' END AS side FROM n WHERE close > top OR close < bottom),
x AS (SELECT a.symbol, a.date, a.side, a.i, min(b.i) FILTER (CASE WHEN a.side = 'BUY' THEN b.close < a.top ELSE b.close > a.bottom END) AS j, count(b.i) AS ahead FROM a LEFT JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 120 GROUP BY ALL)
SELECT x.symbol, x.date, side, CAST(coalesce(j - x.i - 1, ahead) AS INTEGER) AS alive, n.date AS broken_on FROM x LEFT JOIN n ON n.symbol = x.symbol AND n.i = j""",
    "a17_history": _A17_SQL,
    "a18_event_types": _S + "SELECT event_type, count(*) AS new_total, count(DISTINCT (symbol, CAST(available_at AS DATE))) AS active_days FROM signals GROUP BY event_type",
    "k04_page": _B + "SELECT date, symbol, close FROM bars ORDER BY date DESC, symbol LIMIT 50 OFFSET 100",
    "a14_board_evidence": _S[:-1] + """, u AS (SELECT CAST(available_at AS DATE) AS day, symbol, coalesce(sum(value) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(value) FILTER (side = 'SELL'), 0) AS sell, count(side) AS known,
  count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells FROM signals GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN known = 0 THEN 'none' WHEN buys > 0 AND sells > 0 AND abs(buy - sell) < 10 THEN 'CONFLICT' WHEN buy > sell THEN 'BUY' WHEN sell > buy THEN 'SELL' ELSE 'ABSTAIN' END AS direction FROM u),
r AS (SELECT day, '{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}' AS reasons FROM (SELECT day, CASE WHEN known = 0 THEN 'no_evidence' ELSE lower(direction) END AS reason, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY day),
s AS (SELECT day, count(*) AS members, count(*) FILTER (known > 0) AS eligible, avg(buy) FILTER (known > 0) AS mb, avg(sell) FILTER (known > 0) AS ms, count(*) FILTER (direction = 'BUY') AS nb, count(*) FILTER (direction = 'SELL') AS ns,
  count(*) FILTER (direction = 'ABSTAIN') AS na, count(*) FILTER (direction = 'CONFLICT') AS nc, CAST(sum(buys) AS BIGINT) AS buy_events, CAST(sum(sells) AS BIGINT) AS sell_events FROM d GROUP BY day),
g AS (SELECT *, eligible >= 5 AND eligible / members >= 0.8 AS good FROM s)
SELECT day, members, eligible, round(eligible / members, 6) AS coverage, CASE WHEN good THEN round(mb, 5) END AS mean_buy, CASE WHEN good THEN round(ms, 5) END AS mean_sell, CASE WHEN good THEN round(nb / eligible, 6) END AS buy_ratio,
  CASE WHEN good THEN round(ns / eligible, 6) END AS sell_ratio, CASE WHEN good THEN round(na / eligible, 6) END AS abstain_ratio, CASE WHEN good THEN round(nc / eligible, 6) END AS conflict_ratio, buy_events, sell_events, reasons FROM g JOIN r USING (day)""",
    "a15_method_summary": """WITH r AS (SELECT source, n_chars, quality, CASE WHEN quality IS NOT NULL AND n_chars >= 200 THEN 'complete' WHEN quality IS NULL THEN 'unavailable' ELSE 'deferred' END AS status, CASE WHEN quality IS NOT NULL AND n_chars >= 200 THEN CASE WHEN toxic = 1 THEN 'sell' WHEN quality = 1 THEN 'buy' ELSE 'wait' END END AS d FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT source, count(*) AS expected, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (d = 'buy') AS buy, count(*) FILTER (d = 'sell') AS sell, count(*) FILTER (d = 'wait') AS wait,
  count(n_chars) AS forecasts, round(avg(n_chars), 5) AS mean_chars, round(quantile_cont(n_chars, 0.5), 4) AS median_chars, count(quality) AS scores, round(avg(quality), 6) AS mean_score FROM r GROUP BY source)
SELECT *, round(buy / nullif(complete, 0), 6) AS buy_ratio, round(sell / nullif(complete, 0), 6) AS sell_ratio, round(wait / nullif(complete, 0), 6) AS wait_ratio, round(complete / nullif(expected, 0), 6) AS complete_ratio, round(scores / nullif(expected, 0), 6) AS score_ratio FROM p""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
