"""Bars, boards, calendar and ledgers built from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: symbol, date, price, quantity, notional, and the order of lines in a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


def bars_from_trades(rows: DataFrame) -> DataFrame:
    """Daily bars; one shuffle on (symbol, date) with partial aggregation."""
    return rows.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.round(F.sum("quantity"), 2).alias("volume"),
        F.round(F.sum("notional"), 2).alias("amount"),
        F.max((F.col("flag") == "N").cast("int")).alias("verified"),
        F.count("*").alias("n_lines"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by symbol: a day has hardly more lines of a symbol than bars, so the lines go to their symbol at once and are sorted there.

    Windows and groups by symbol that follow find the bars in place and in order.
    """
    return bars_from_trades(trades(spark, sf_dir).repartition("symbol"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and their index from 1.

    The distinct dates are aggregated before the unpartitioned window, so that task sees one row per
    session (about 250 a year) however many bars there are.
    """
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return days.selectExpr("date", "row_number() OVER (ORDER BY date) AS session")


def industry_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One industry board per symbol: the supplier's nation."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("board"))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("symbol"), "board")


def concepts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept boards of a symbol: the brands of the parts that it supplies (many to many).

    Lines meet their brand as they are: hardly one repeats a symbol's part, and a symbol has few brands, so they are told apart once, after the join.
    """
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("board"))
    return trades(spark, sf_dir).select("symbol", "part").join(brand, "part").select("symbol", "board").distinct()


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of accounts: orders of customers, finished ones as sells."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account"),
        F.col("o_orderkey").alias("fill_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.col("o_totalprice").alias("notional"),
        (F.floor(F.col("o_totalprice") / 1000) + 1).cast("long").alias("shares"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence events per user: purchases support, errors resist."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("symbol"),
        F.col("ts").cast("timestamp").alias("available_at"),
        "event_type",
        F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL").alias("side"),
        "value",
    )
