"""Outcomes of entries: each bought lot with the sales that close it, its risk and multiple of risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import sql
from ..sources.tables import fills
from .accounts import ORACLE as ACCOUNTS
from .accounts import a28_fifo


@dataclass(frozen=True)
class Terms:
    """Where the stop stands below the entry, what counts as a risk that can be judged, and what makes an outcome high or low."""

    stop: float = 0.08
    slippage: float = 0.0025
    least_risk: float = 0.01
    most_risk: float = 0.2
    high_return: float = 0.1
    high_multiple: float = 1.0
    low_return: float = 0.02


def episodes(entries: DataFrame, matches: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """One row for each bought lot of ``entries`` (fills), closed by ``matches`` (sell, buy, shares).

    Cash counts with its fees, a sale's by its share of the lot.  The initial risk is frozen at the
    fill: what is paid less what a sale at the stop would bring.  Only a lot that is sold out has an
    outcome; without a risk inside the limits it has a return but no class.
    """
    price = F.col("notional") / F.col("shares")
    buys = entries.filter("side = 'BUY'").select(F.col("fill_id").alias("buy"), "account", F.col("date").alias("entry_date"), "shares", price.alias("price"), (F.col("notional") + C.fee(F.col("side"), F.col("notional"))).alias("paid"))
    sells = entries.filter("side = 'SELL'").select(F.col("fill_id").alias("sell"), F.col("date").alias("exit_date"), F.col("shares").alias("of"), (F.col("notional") - C.fee(F.col("side"), F.col("notional"))).alias("cash"))
    closed = matches.select("sell", "buy", F.col("shares").alias("sold")).join(sells, "sell").groupBy("buy").agg(
        F.sum("sold").alias("sold"), F.sum(F.col("sold") / F.col("of") * F.col("cash")).alias("received"), F.max("exit_date").alias("exit_date"), F.count("*").alias("exits")
    )
    rows = buys.join(closed, "buy", "left").fillna({"sold": 0, "received": 0.0, "exits": 0})
    brings = F.col("shares") * F.round(F.col("price") * (1 - terms.stop) * (1 - terms.slippage), 2)
    rows = rows.withColumn("risk", F.col("paid") - (brings - C.fee(F.lit("SELL"), brings)))
    done = F.col("sold") == F.col("shares")
    rows = rows.withColumns({"net": F.when(done, F.col("received") - F.col("paid")), "judged": (F.col("risk") / F.col("paid")).between(terms.least_risk, terms.most_risk)})
    net_return, multiple = F.col("net") / F.col("paid"), F.when(F.col("judged"), F.col("net") / F.col("risk"))
    high = (net_return >= terms.high_return) & (multiple >= terms.high_multiple)
    klass = F.when(~done, "open").when(~F.col("judged"), "no_risk").when(high, "high").when(F.col("net") <= 0, "loss").otherwise("ordinary")
    return rows.select(
        "buy", "account", "entry_date", F.when(done, F.col("exit_date")).alias("exit_date"), "exits", (F.col("shares") - F.col("sold")).alias("open_shares"), F.round("risk", 4).alias("risk_cash"),
        F.round(net_return, 6).alias("net_return"), F.round(multiple, 5).alias("r_multiple"), klass.alias("klass"), F.coalesce((klass == "ordinary") & (net_return < terms.low_return), F.lit(False)).alias("low_return"),
    )


def a29_entry_episodes(spark, sf_dir):
    """Each bought lot's outcome after first-in first-out sales."""
    return episodes(fills(spark, sf_dir), a28_fifo(spark, sf_dir))


_FEE = f"(greatest({{0}} * {C.COMMISSION}::DOUBLE, {C.MIN_COMMISSION}) + {{1}})"
_SELL_FEE = lambda x: _FEE.format(x, f"{x} * {C.SELL_TAX}::DOUBLE")
ORACLE = {
    "a29_entry_episodes": "WITH f AS (" + sql.with_(sql.FILLS) + "SELECT * FROM fills), m AS (" + ACCOUNTS["a28_fifo"] + f"""),
s AS (SELECT fill_id AS sell, date AS exit_date, shares AS of, notional - {_SELL_FEE('notional')} AS cash FROM f WHERE side = 'SELL'),
c AS (SELECT buy, CAST(sum(shares) AS BIGINT) AS sold, sum(shares / of * cash) AS received, max(exit_date) AS exit_date, count(*) AS exits FROM m JOIN s USING (sell) GROUP BY buy),
b AS (SELECT fill_id AS buy, account, date AS entry_date, shares, notional + {_FEE.format('notional', '0')} AS paid, shares * round(notional / shares * (1 - 0.08::DOUBLE) * (1 - 0.0025::DOUBLE), 2) AS brings FROM f WHERE side = 'BUY'),
r AS (SELECT b.*, coalesce(sold, 0) AS sold, coalesce(exits, 0) AS exits, exit_date, paid - (brings - {_SELL_FEE('brings')}) AS risk, CASE WHEN sold = shares THEN received - paid END AS net FROM b LEFT JOIN c USING (buy)),
j AS (SELECT *, risk / paid BETWEEN 0.01 AND 0.2 AS judged, net / paid AS ret FROM r),
k AS (SELECT *, CASE WHEN judged THEN net / risk END AS multiple, CASE WHEN sold <> shares THEN 'open' WHEN NOT judged THEN 'no_risk' WHEN ret >= 0.1 AND net / risk >= 1 THEN 'high' WHEN net <= 0 THEN 'loss' ELSE 'ordinary' END AS klass FROM j)
SELECT buy, account, entry_date, CASE WHEN sold = shares THEN exit_date END AS exit_date, exits, shares - sold AS open_shares, round(risk, 4) AS risk_cash, round(ret, 6) AS net_return, round(multiple, 5) AS r_multiple, klass, coalesce(klass = 'ordinary' AND ret < 0.02, false) AS low_return FROM k""",
}
QUERIES = {"a29_entry_episodes": a29_entry_episodes}
