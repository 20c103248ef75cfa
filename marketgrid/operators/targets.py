"""Target fraction of a position from probabilities, risk limits and a predictive gate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans import sql
from ..sources.tables import bars_daily
from .trailing import PLANS


@dataclass(frozen=True)
class Policy:
    """Limits of the target path; all are parameters.  Targets are whole steps."""

    max_weight: float = 0.2
    step: float = 0.05
    hysteresis: float = 0.01
    wait_band: float = 0.02
    edge_entry: float = 0.03
    edge_full: float = 0.3
    gate_bars: int = 250
    gate_least: int = 20
    gate_rate: float = 0.5


#: Parts of a step in which wishes are whole numbers, so that thresholds are met exactly or not.
PARTS = 1_000_000


def gate(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``passed``: whether the edge pointed the right way often enough among the last bars whose next close is known.

    Edges inside the wait band say nothing.  Too few of the others, and the gate is not passed.
    """
    by = Window.partitionBy("symbol").orderBy("date")
    edge, ahead = F.col("up") - F.col("down"), F.lead("close").over(by) - F.col("close")
    rows = rows.withColumn("hit", F.when(F.abs(edge) > policy.wait_band, (F.signum(edge) == F.signum(ahead)).cast("int")))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"known": F.count("hit").over(so_far), "right": F.coalesce(F.sum("hit").over(so_far), F.lit(0))})
    # Whole counts of the last bars are the difference of two counts from the start.
    last = lambda x: F.coalesce(F.lag(x).over(by), F.lit(0)) - F.coalesce(F.lag(x, policy.gate_bars + 1).over(by), F.lit(0))
    enough = (last("known") >= policy.gate_least) & (last("right") >= policy.gate_rate * last("known"))
    return rows.withColumn("passed", enough).drop("hit", "known", "right")


def asked(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What each bar asks for, whatever is held: ``mode``, the ``ceiling`` in steps and the ``wish`` in parts of a step."""
    edge, cap = F.col("up") - F.col("down"), F.least("cap", F.lit(policy.max_weight))
    known = F.col("up").between(0, 1) & F.col("down").between(0, 1) & F.col("cap").between(0, 1)
    mode = F.when(~F.coalesce(known, F.lit(False)), "stale").when(~F.coalesce("passed", F.lit(False)), "gate").when(F.abs(edge) <= policy.wait_band, "wait").otherwise("free")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (edge - policy.edge_entry) / (policy.edge_full - policy.edge_entry)))
    whole = lambda x: F.round(x / policy.step * PARTS).cast("long")
    return rows.withColumns({"mode": mode, "ceiling": F.floor(whole(cap) / PARTS).cast("int"), "wish": whole(cap * share)})


def levels(bars: Iterable[tuple], policy: Policy = Policy()) -> Iterator[tuple]:
    """Level, frozen stop and reason after each bar (close, mode, ceiling, wish, stop) of a symbol in order.

    A close under the frozen stop ends the position.  Without inputs the level stays; without the gate,
    or in the wait band, it may only fall to the ceiling; else it goes to the nearest step, if the
    wish is more than half a step and the hysteresis away.  The stop only rises while a level is held.
    """
    away = round((0.5 + policy.hysteresis / policy.step) * PARTS)
    level, frozen = 0, None
    for close, mode, ceiling, wish, stop in bars:
        broke = frozen is not None and close is not None and close < frozen
        wanted = level
        if mode == "free" and abs(wish - level * PARTS) >= away:
            wanted = (wish + PARTS // 2) // PARTS
        over = ceiling is not None and wanted > ceiling
        if broke:
            after, why = 0, "stop"
        elif mode == "stale":
            after, why = level, "stale"
        else:
            after = ceiling if over else wanted
            why = "cap" if over else mode if mode != "free" else "moved" if after != level else "hold"
        if after <= 0:
            frozen = None
        elif mode in ("wait", "free") and stop is not None:
            frozen = stop if frozen is None else max(stop, frozen)
        level = after
        yield level, frozen, why


def target_path(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``target``, frozen ``stop`` and ``why`` of each bar of rows (symbol, date, close, mode, ceiling, wish, stop).

    Each target depends on the one before, so a symbol's bars, some thousands, are one ordered group that is passed once.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL("symbol long, date date, level int, stop double, why string"))

    def run(bars: pa.Table) -> pa.Table:
        bars = bars.sort_by("date")
        found = levels(zip(*(bars[c].to_pylist() for c in ("close", "mode", "ceiling", "wish", "stop")), strict=True), policy)
        return pa.Table.from_arrays([bars["symbol"].combine_chunks(), bars["date"].combine_chunks(), *map(pa.array, zip(*found, strict=True), kinds.types[2:])], schema=kinds)

    asked_of = rows.select("symbol", "date", "close", "mode", "ceiling", "wish", "stop")
    out = asked_of.groupBy("symbol").applyInArrow(run, "symbol long, date date, level int, stop double, why string")
    return out.select("symbol", "date", F.round(F.col("level") * policy.step, 6).alias("target"), "stop", "why")


def w50_target_path(spark, sf_dir):
    """Target fraction of each symbol with predictive gate, hysteresis, wait band, cap and frozen stop.

    Probabilities are those of the batch score with the sides swapped, as the supplied closes revert and
    no gate would pass otherwise; cap and stop are those of the risk geometry.
    """
    z = F.round(F.col("close") / F.col("open") - 1, 6) * 5
    odds = [F.exp(x / 1.5) for x in (z, F.lit(0.2), -z)]
    total = odds[0] + odds[1] + odds[2]
    risk = PLANS["w47_risk_geometry"].frame(spark, sf_dir).select("symbol", "date", F.col("floor_price").alias("stop"), F.when(F.col("verdict") == "ok", F.col("cap")).when(F.col("verdict") != "unavailable", 0.0).alias("cap"))
    rows = bars_daily(spark, sf_dir).select("symbol", "date", "close", F.round(odds[2] / total, 9).alias("up"), F.round(odds[0] / total, 9).alias("down")).join(risk, ["symbol", "date"])
    return target_path(asked(gate(rows)))


ORACLE = {
    "w50_target_path": sql.with_(sql.BARS).replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, z AS (SELECT symbol, date, close, round(close / open - 1, 6) * 5 AS z FROM bars),
o AS (SELECT symbol, date, close, exp(z / 1.5) AS a, exp(0.2::DOUBLE / 1.5) AS b, exp(-z / 1.5) AS c FROM z),
k AS (""" + PLANS["w47_risk_geometry"].oracle() + """),
p AS (SELECT o.symbol, o.date, close, round(c / (a + b + c), 9) AS up, round(a / (a + b + c), 9) AS down, floor_price AS stop, CASE WHEN verdict = 'ok' THEN cap WHEN verdict <> 'unavailable' THEN 0.0 END AS cap,
  row_number() OVER (PARTITION BY o.symbol ORDER BY o.date) AS i, lead(close) OVER (PARTITION BY o.symbol ORDER BY o.date) - close AS ahead FROM o JOIN k ON o.symbol = k.symbol AND o.date = k.date),
h AS (SELECT *, CASE WHEN abs(up - down) > 0.02::DOUBLE THEN CAST(sign(up - down) = sign(ahead) AS INTEGER) END AS hit FROM p),
g AS (SELECT *, count(hit) OVER w >= 20 AND sum(hit) OVER w >= 0.5 * count(hit) OVER w AS passed FROM h WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
q AS (SELECT symbol, i, date, close, stop, CASE WHEN NOT coalesce(up BETWEEN 0 AND 1 AND down BETWEEN 0 AND 1 AND cap BETWEEN 0 AND 1, false) THEN 'stale' WHEN NOT coalesce(passed, false) THEN 'gate' WHEN abs(up - down) <= 0.02::DOUBLE THEN 'wait' ELSE 'free' END AS mode,
  floor(round(least(cap, 0.2::DOUBLE) / 0.05::DOUBLE * 1000000) / 1000000) AS ceiling, round(least(cap, 0.2::DOUBLE) * greatest(0, least(1, (up - down - 0.03::DOUBLE) / (0.3::DOUBLE - 0.03::DOUBLE))) / 0.05::DOUBLE * 1000000) AS wish FROM g),
path AS (SELECT symbol, CAST(0 AS BIGINT) AS i, NULL::DATE AS date, 0::DOUBLE AS level, NULL::DOUBLE AS stop, '' AS why FROM (SELECT DISTINCT symbol FROM q)
  UNION ALL SELECT symbol, i, date, after, CASE WHEN after > 0 THEN CASE WHEN mode IN ('wait', 'free') AND own IS NOT NULL THEN greatest(own, coalesce(held, own)) ELSE held END END,
    CASE WHEN broke THEN 'stop' WHEN mode = 'stale' THEN 'stale' WHEN wanted > ceiling THEN 'cap' WHEN mode <> 'free' THEN mode WHEN after <> level THEN 'moved' ELSE 'hold' END
  FROM (SELECT *, CASE WHEN broke THEN 0 WHEN mode = 'stale' THEN level ELSE least(wanted, ceiling) END AS after FROM (
    SELECT q.symbol, q.i, q.date, mode, ceiling, q.stop AS own, x.stop AS held, level, coalesce(close < x.stop, false) AS broke,
      CASE WHEN mode = 'free' AND abs(wish - level * 1000000) >= 700000 THEN floor((wish + 500000) / 1000000) ELSE level END AS wanted FROM path x JOIN q ON q.symbol = x.symbol AND q.i = x.i + 1)))
SELECT symbol, date, round(level * 0.05, 6) AS target, stop, why FROM path WHERE i > 0""",
}
QUERIES = {"w50_target_path": w50_target_path}
