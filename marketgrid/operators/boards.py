"""Board metrics, rankings and peer comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import full, prior, ratio
from ..plans import sql
from ..sources.tables import bars_daily, bars_from_trades, concepts_of, industry_of, trades

MIN_MEMBERS, TOP = 2, 30

DAILY = {
    "ret_1": f"{ratio('close', prior('close'))} - 1",
    "ma20": full("avg", "close", 20),
    "high20": full("max", "high", 20, 1),
    "ret_20": f"{ratio('close', prior('close', 20))} - 1",
}
_DAILY_SQL = f"daily AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in DAILY.items())} FROM bars)"
MEMBERS_SQL = """members AS (
  SELECT 'industry' AS kind, symbol, board FROM industry UNION ALL SELECT 'concept' AS kind, symbol, board FROM concepts)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the own metrics that boards average."""
    return bars_daily(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in DAILY.items()))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, symbol, board) of industries and concepts, exploded."""
    industry = industry_of(spark, sf_dir).select(F.lit("industry").alias("kind"), "symbol", "board")
    return industry.unionByName(concepts_of(spark, sf_dir).select(F.lit("concept").alias("kind"), "symbol", "board"))


def _alike(membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols with the same boards as one class, named by a digest of these: (symbol, class) and (class, kind, board)."""
    of = membership.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("kind", "board"))).alias("boards"))
    of = of.withColumn("class", F.md5(F.to_json("boards")))
    boards = of.groupBy("class").agg(F.first("boards").alias("boards")).select("class", F.explode("boards").alias("of"))
    return of.select("symbol", "class"), boards.select("class", "of.kind", "of.board")


def board_daily(bars: DataFrame, membership: DataFrame, least: int = MIN_MEMBERS) -> DataFrame:
    """Metrics of each (kind, board, date); ratios are null below ``least`` known members.

    Symbols with the same boards are summed by date first, and only these sums multiply by their
    boards: a bar is not repeated for each of its boards.  Spark chooses the joins.
    """
    alike, boards = _alike(membership)
    above = {"advance_ratio": ("ret_1", F.col("ret_1") > 0), "above_ma20": ("ma20", F.col("close") > F.col("ma20")), "breakout": ("high20", F.col("close") > F.col("high20"))}
    counts = {"n_members": F.count("*"), "total": F.sum("ret_1"), "amount": F.sum("amount")}
    for name, (of, holds) in above.items():
        counts |= {f"{name}_of": F.count(of), f"{name}_known": F.count(holds), f"{name}_true": F.count_if(holds)}
    sums = bars.join(alike, "symbol").groupBy("class", "date").agg(*(x.alias(name) for name, x in counts.items()))
    rows = sums.join(boards, "class").groupBy("kind", "board", "date").agg(*(F.sum(name).alias(name) for name in counts))
    known = F.col("advance_ratio_of")
    ratio_of = lambda name: F.when(F.col(f"{name}_of") >= least, F.try_divide(f"{name}_true", f"{name}_known")).alias(name)
    return rows.select(
        "kind", "board", "date", "n_members", known.alias("n_known"), F.when(known >= least, F.col("total") / known).alias("mean_return"),
        *map(ratio_of, above), "amount",
    )


_BOARD_SQL = f"""board_daily AS (
  SELECT kind, board, date, count(*) AS n_members, count(ret_1) AS n_known,
    CASE WHEN count(ret_1) >= {MIN_MEMBERS} THEN avg(ret_1) END AS mean_return,
    CASE WHEN count(ret_1) >= {MIN_MEMBERS} THEN avg(CAST(ret_1 > 0 AS INT)) END AS advance_ratio,
    CASE WHEN count(ma20) >= {MIN_MEMBERS} THEN avg(CAST(close > ma20 AS INT)) END AS above_ma20,
    CASE WHEN count(high20) >= {MIN_MEMBERS} THEN avg(CAST(close > high20 AS INT)) END AS breakout,
    sum(amount) AS amount
  FROM daily JOIN members USING (symbol) GROUP BY kind, board, date)"""
BOARDS = (sql.BARS, sql.INDUSTRY, sql.CONCEPTS, MEMBERS_SQL, _DAILY_SQL, _BOARD_SQL)


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board_daily(daily(spark, sf_dir), members(spark, sf_dir))


def a08_board_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("mean_return", "advance_ratio", "above_ma20", "breakout")
    return _boards(spark, sf_dir).select(
        "kind", "board", "date", "n_members", "n_known", *(F.round(n, 6).alias(n) for n in names), F.round("amount", 2).alias("amount")
    )


def a09_market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    market = bars.groupBy("date").agg(F.sum("amount").alias("market_amount"))
    own = bars.join(industry_of(spark, sf_dir), "symbol").groupBy("board", "date").agg(F.sum("amount").alias("amount"))
    return own.join(market, "date").select(
        "board", "date", F.round("market_amount", 2).alias("market_amount"),
        F.round(F.col("amount") / F.col("market_amount"), 8).alias("share"),
    )


def _windows(frame: DataFrame) -> DataFrame:
    by = Window.partitionBy("kind", "board").orderBy("date")
    last20, before20 = by.rowsBetween(-19, 0), by.rowsBetween(-20, -1)
    full20 = F.count("mean_return").over(last20) == 20
    return frame.select(
        "*",
        F.when(full20, F.sum(F.log1p("mean_return")).over(last20)).alias("log_return_20"),
        F.when(full20, F.stddev_samp("mean_return").over(last20) * F.sqrt(F.lit(252.0))).alias("volatility_20"),
        F.when(full20, F.array_agg("mean_return").over(last20)).alias("path"),
        F.when(F.count("amount").over(before20) == 20, F.col("amount") / F.avg("amount").over(before20)).alias("relative_amount20"),
    )


def a10_compound_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_boards(spark, sf_dir)).select("kind", "board", "date", F.round("log_return_20", 6).alias("log_return_20"))


def w27_volatility_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised volatility and worst drawdown of a net value that starts at 1; a fold over 20 values."""
    start = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        nav = acc["nav"] * (1 + x)
        peak = F.greatest(acc["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.least(acc["worst"], nav / peak - 1).alias("worst"))

    return _windows(_boards(spark, sf_dir)).select(
        "kind", "board", "date", F.round("volatility_20", 6).alias("volatility_20"),
        F.round(F.aggregate("path", start, step, lambda acc: acc["worst"]), 6).alias("max_drawdown"),
    )


def w28_relative_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_boards(spark, sf_dir)).select(
        "kind", "board", "date", F.round("relative_amount20", 6).alias("relative_amount20")
    )


def _peer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).join(industry_of(spark, sf_dir), "symbol")


def j10_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board means without the member itself: sums less the own value, no second aggregation per member."""
    rows = _peer_rows(spark, sf_dir)
    sums = rows.groupBy("board", "date").agg(F.sum("ret_1").alias("total"), F.count("ret_1").alias("known"))
    others = F.col("known") - F.col("ret_1").isNotNull().cast("long")
    return rows.join(sums, ["board", "date"]).select(
        "symbol", "board", "date", others.alias("n_peers"),
        F.round(F.when(others >= 1, (F.col("total") - F.coalesce("ret_1", F.lit(0.0))) / others), 6).alias("peer_return"),
    )


def w30_peer_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of peers below plus half the ties, the member itself left out."""
    rows = _peer_rows(spark, sf_dir).filter("ret_20 IS NOT NULL")
    group = Window.partitionBy("board", "date")
    below = F.rank().over(group.orderBy("ret_20")) - 1
    ties = F.count("*").over(Window.partitionBy("board", "date", "ret_20")) - 1
    peers = F.count("*").over(group) - 1
    return rows.select(
        "symbol", "board", "date", peers.alias("n_peers"),
        F.round(F.when(peers >= 1, (below + ties * 0.5) / peers), 6).alias("percentile"),
    )


#: Sessions that the latest session's ranking looks back over: 20, the 20 before them and itself.
LOOKBACK = 41


def _last_days(spark: SparkSession, sf_dir: str, sessions: int) -> tuple[Column, Column]:
    """The first and the last of the last ``sessions`` sessions, as constants: one pass over a column, and frames that need them are not worked out twice."""
    last = trades(spark, sf_dir).select("date").distinct().orderBy(F.desc("date")).limit(sessions).agg(F.min("date"), F.max("date")).first()
    return tuple(F.lit(x).cast("date") for x in last)


def _recent(spark: SparkSession, sf_dir: str, sessions: int = LOOKBACK) -> tuple[DataFrame, Column]:
    """Board rows of the last ``sessions`` sessions, and the last one.

    Bars are cut to them before they multiply by their boards; their own metrics look back over a symbol's
    bars, however far apart those are, and so over the whole table.
    """
    since, last = _last_days(spark, sf_dir, sessions)
    return board_daily(daily(spark, sf_dir).filter(F.col("date") >= since), members(spark, sf_dir)), last


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent, day = _recent(spark, sf_dir)
    last = _windows(recent).drop("path").filter(F.col("date") == day)
    active = last.filter("relative_amount20 IS NOT NULL AND mean_return IS NOT NULL")
    # Rounded, so that boards with the same members tie however their sums were ordered.
    active = active.withColumn("move", F.round(F.abs("mean_return"), 8)).withColumn("relative_amount20", F.round("relative_amount20", 8))
    kind = Window.partitionBy("kind")

    def percentile(name: str):
        below = F.rank().over(kind.orderBy(name)) - 1
        ties = F.count("*").over(Window.partitionBy("kind", name))
        n = F.count("*").over(kind)
        return F.when(n == 1, F.lit(0.5)).otherwise((below + (ties - 1) / 2.0) / (n - 1))

    return active.select(
        "kind", "board", "date", F.round(50 * (percentile("relative_amount20") + percentile("move")), 6).alias("score")
    )


def w31_board_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top boards of the latest session by activity; the ranked population is one row per board."""
    order = Window.partitionBy("kind").orderBy(F.desc("score"), "board")
    return _ranking(spark, sf_dir).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= TOP)


def k03_top_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("kind").orderBy(F.desc("amount"), "board")
    last = _recent(spark, sf_dir, 1)[0].select("kind", "board", F.round("amount", 2).alias("amount"))
    return last.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= TOP)


def a13_capital_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount of each board over its last 90, 50 and 20 sessions."""
    back = Window.partitionBy("kind", "board").orderBy(F.desc("date"))
    rows = _boards(spark, sf_dir).withColumn("back", F.row_number().over(back)).filter("back <= 90")
    return rows.groupBy("kind", "board").agg(
        *(F.round(F.sum(F.when(F.col("back") <= n, F.col("amount"))), 2).alias(f"amount_{n}") for n in (90, 50, 20))
    )


def a11_concept_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily return of the concept boards that a symbol belongs to, on the latest session."""
    last = _recent(spark, sf_dir, 1)[0].filter("kind = 'concept'").select("board", "mean_return")
    return concepts_of(spark, sf_dir).join(last, "board", "left").groupBy("symbol").agg(
        F.count("*").alias("n_concepts"), F.count("mean_return").alias("known"),
        F.round(F.avg("mean_return"), 6).alias("concept_return"),
        F.round(F.avg((F.col("mean_return") > 0).cast("double")), 6).alias("positive_ratio"),
    )


def j09_board_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each board with their bar of the last session, of which only the lines are read; absent ones are labelled."""
    day = _last_days(spark, sf_dir, 1)[1]
    last = bars_from_trades(trades(spark, sf_dir).filter(F.col("date") == day)).select("symbol", "close")
    return members(spark, sf_dir).join(last, "symbol", "left").select(
        "kind", "board", "symbol", F.when(F.col("close").isNull(), "not_in_scan").otherwise("scanned").alias("status"), "close"
    )


_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in ("mean_return", "advance_ratio", "above_ma20", "breakout"))
_BY = "OVER (PARTITION BY kind, board ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_FULL = f"count(mean_return) {_BY} = 20"
_BEFORE = "OVER (PARTITION BY kind, board ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_REL = f"CASE WHEN count(amount) {_BEFORE} = 20 THEN amount / avg(amount) {_BEFORE} END"
_LATEST = "date = (SELECT max(date) FROM bars)"
_PCT = "CASE WHEN count(*) OVER k = 1 THEN 0.5 ELSE (rank() OVER (k ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY kind, {0}) - 1) / 2.0) / (count(*) OVER k - 1) END"
_W = sql.with_(*BOARDS)

ORACLE = {
    "a08_board_daily": _W + f"SELECT kind, board, date, n_members, n_known, {_ROUNDED}, round(amount, 2) AS amount FROM board_daily",
    "a09_market_share": sql.with_(sql.BARS, sql.INDUSTRY)
    + """SELECT board, date, round(market_amount, 2) AS market_amount, round(amount / market_amount, 8) AS share
FROM (SELECT board, date, sum(amount) AS amount FROM bars JOIN industry USING (symbol) GROUP BY board, date)
JOIN (SELECT date, sum(amount) AS market_amount FROM bars GROUP BY date) USING (date)""",
    "a10_compound_return": _W
    + f"SELECT kind, board, date, round(CASE WHEN {_FULL} THEN sum(ln(1 + mean_return)) {_BY} END, 6) AS log_return_20 FROM board_daily",
    "w27_volatility_drawdown": _W
    + f""", windows AS (SELECT kind, board, date, CASE WHEN {_FULL} THEN stddev_samp(mean_return) {_BY} * sqrt(252.0) END AS vol, CASE WHEN {_FULL} THEN list(mean_return) {_BY} END AS path FROM board_daily)
SELECT kind, board, date, round(vol, 6) AS volatility_20, CASE WHEN path IS NOT NULL THEN round(list_reduce(
  list_prepend({{'r': 0.0::DOUBLE, 'nav': 1.0::DOUBLE, 'peak': 1.0::DOUBLE, 'worst': 0.0::DOUBLE}}, list_transform(path, lambda r: {{'r': r, 'nav': 0.0::DOUBLE, 'peak': 0.0::DOUBLE, 'worst': 0.0::DOUBLE}})),
  lambda x, y: {{'r': y.r, 'nav': x.nav * (1 + y.r), 'peak': greatest(x.peak, x.nav * (1 + y.r)), 'worst': least(x.worst, x.nav * (1 + y.r) / greatest(x.peak, x.nav * (1 + y.r)) - 1)}}).worst, 6) END AS max_drawdown
FROM windows""",
    "w28_relative_amount": _W + f"SELECT kind, board, date, round({_REL}, 6) AS relative_amount20 FROM board_daily",
    "j10_peers": sql.with_(sql.BARS, sql.INDUSTRY, _DAILY_SQL)
    + """SELECT symbol, board, date, known - CAST(ret_1 IS NOT NULL AS INT) AS n_peers,
  round(CASE WHEN known - CAST(ret_1 IS NOT NULL AS INT) >= 1
    THEN (total - coalesce(ret_1, 0)) / (known - CAST(ret_1 IS NOT NULL AS INT)) END, 6) AS peer_return
FROM (SELECT *, sum(ret_1) OVER (PARTITION BY board, date) AS total, count(ret_1) OVER (PARTITION BY board, date) AS known
  FROM daily JOIN industry USING (symbol))""",
    "w30_peer_percentile": sql.with_(sql.BARS, sql.INDUSTRY, _DAILY_SQL)
    + """, peers AS (SELECT symbol, board, date, ret_20 FROM daily JOIN industry USING (symbol) WHERE ret_20 IS NOT NULL)
SELECT a.symbol, a.board, a.date, count(b.symbol) AS n_peers,
  round(sum(CASE WHEN b.ret_20 < a.ret_20 THEN 1.0 WHEN b.ret_20 = a.ret_20 THEN 0.5 ELSE 0 END) / nullif(count(b.symbol), 0), 6) AS percentile
FROM peers a LEFT JOIN peers b ON a.board = b.board AND a.date = b.date AND a.symbol <> b.symbol
GROUP BY a.symbol, a.board, a.date""",
    "w31_board_activity": _W
    + f""", latest AS (SELECT kind, board, date, round(relative_amount20, 8) AS relative_amount20, round(abs(mean_return), 8) AS move FROM
  (SELECT *, {_REL} AS relative_amount20 FROM board_daily WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT {LOOKBACK})))
  WHERE {_LATEST} AND relative_amount20 IS NOT NULL AND mean_return IS NOT NULL),
scored AS (SELECT kind, board, date, round(50 * ({_PCT.format('relative_amount20')} + {_PCT.format('move')}), 6) AS score
  FROM latest WINDOW k AS (PARTITION BY kind))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, board) AS position FROM scored)
WHERE position <= {TOP}""".replace("OVER (k ORDER BY", "OVER (PARTITION BY kind ORDER BY"),
    "k03_top_capital": _W
    + f"""SELECT * FROM (SELECT kind, board, round(amount, 2) AS amount,
  row_number() OVER (PARTITION BY kind ORDER BY round(amount, 2) DESC, board) AS position
  FROM board_daily WHERE {_LATEST}) WHERE position <= {TOP}""",
    "a13_capital_history": _W
    + """SELECT kind, board, round(sum(CASE WHEN back <= 90 THEN amount END), 2) AS amount_90,
  round(sum(CASE WHEN back <= 50 THEN amount END), 2) AS amount_50, round(sum(CASE WHEN back <= 20 THEN amount END), 2) AS amount_20
FROM (SELECT *, row_number() OVER (PARTITION BY kind, board ORDER BY date DESC) AS back FROM board_daily) WHERE back <= 90
GROUP BY kind, board""",
    "a11_concept_means": _W
    + f"""SELECT symbol, count(*) AS n_concepts, count(mean_return) AS known, round(avg(mean_return), 6) AS concept_return,
  round(avg(CAST(mean_return > 0 AS INT)), 6) AS positive_ratio
FROM concepts LEFT JOIN (SELECT board, mean_return FROM board_daily WHERE kind = 'concept' AND {_LATEST}) USING (board)
GROUP BY symbol""",
    "j09_board_members": sql.with_(sql.BARS, sql.INDUSTRY, sql.CONCEPTS, MEMBERS_SQL)
    + f"""SELECT kind, board, symbol, CASE WHEN close IS NULL THEN 'not_in_scan' ELSE 'scanned' END AS status, close
FROM members LEFT JOIN (SELECT symbol, close FROM bars WHERE {_LATEST}) USING (symbol)""",
}
ORACLE["entry_board_ranking"] = ORACLE["w31_board_activity"]
QUERIES = {name: globals()[name] for name in ORACLE if name in globals()} | {"entry_board_ranking": w31_board_activity}
