"""Trailing features look back only: a prefix of the bars gives the same rows, and changing the future changes nothing before."""

import datetime

import pytest
from pyspark.sql import functions as F

from marketgrid.operators import events, trailing
from marketgrid.sources.tables import bars_daily

SF = "/root/testdata/sf0.001"
CUT = datetime.date(1998, 6, 1)
# Labels look ahead by design, and ranking from the end depends on it.
FORWARD = {"w23_direction_label", "w24_atr_label", "w25_observations", "k01_last_bars"}


def rows(frame):
    return sorted(map(str, frame.filter(F.col("date") < F.lit(CUT)).collect()))


def apply(plan, bars):
    for stage in plan.stages:
        bars = bars.selectExpr("*", *(f"{e} AS {n}" for n, e in stage.items()))
    if plan.where:
        bars = bars.filter(plan.where)
    return bars.selectExpr(*(f"{e} AS {n}" for n, e in plan.select.items()))


@pytest.fixture(scope="module")
def bars(spark):
    return bars_daily(spark, SF).filter("symbol < 3").cache()


@pytest.mark.parametrize("name", ["w02_averages", "w04_atr", "w07_volume_ratios", "w09_quality_window", "w10_price_volume", "w12_range_duration", "w43_demand_supply"])
def test_prefix_and_future(bars, name):
    assert name not in FORWARD
    plan = trailing.PLANS[name]
    want = rows(apply(plan, bars))
    assert rows(apply(plan, bars.filter(F.col("date") < F.lit(CUT)))) == want
    changed = bars.withColumn("close", F.when(F.col("date") >= F.lit(CUT), F.col("close") * 3).otherwise(F.col("close")))
    assert rows(apply(plan, changed)) == want


def test_detector_prefix(bars):
    want = rows(events.detect(bars))
    assert rows(events.detect(bars.filter(F.col("date") < F.lit(CUT)))) == want


def test_stream_equals_batch(spark):
    from marketgrid.streaming import jobs

    batch = {(r.symbol, r.date): r for r in events.w14_events(spark, SF).collect()}
    stream = {(r.symbol, r.date): r for r in jobs.t02_stream_events(spark, SF).collect()}
    assert batch == stream  # over two runs, the second from the saved state


def test_upsert_later_write_wins(spark, tmp_path):
    from marketgrid.sources.stores import import_snapshot
    from marketgrid.sources.versioned import read_table, upsert

    at = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "b")], "k long, v double, p string")
    upsert(spark, first, at, ["k"], "v", "p")
    upsert(spark, spark.createDataFrame([(1, 0.5, "a"), (3, 9.0, "a")], first.schema), at, ["k"], "v", "p")
    assert sorted((r.k, r.v) for r in read_table(spark, at, first.schema, "p").collect()) == [(1, 0.5), (2, 1.0), (3, 9.0)]
    for _ in range(2):
        import_snapshot(spark, first, f"{at}-s", ["k", "p"])
    assert spark.read.parquet(f"{at}-s").count() == 2
