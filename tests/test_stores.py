"""Versioned tables, kept sums and resumed streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrid.operators import events
from marketgrid.sources import versioned
from marketgrid.sources.stores import shared
from marketgrid.sources.tables import bars_daily
from marketgrid.streaming import jobs

SF = "/root/testdata/sf0.001"
ROW = "k long, v double, part string"


@pytest.fixture
def store(spark):
    path, schema = shared(spark), T.StructType.fromDDL(ROW)
    put = lambda rows, **more: versioned.upsert(spark, spark.createDataFrame(rows, schema), path, ["k"], "v", "part", **more)
    held = lambda: sorted(map(tuple, versioned.read_table(spark, path, schema, "part").collect()))
    return path, put, held


def test_later_writes_win_and_keys_move(store):
    _, put, held = store
    assert held() == []
    put([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b")])
    put([(1, 0.5, "b"), (2, 9.0, "a"), (2, 8.0, "a")])
    assert held() == [(1, 0.5, "b"), (2, 9.0, "a"), (3, 3.0, "b")]
    put([(2, 1.0, "c")])  # partition a is empty now
    assert held() == [(1, 0.5, "b"), (2, 1.0, "c"), (3, 3.0, "b")]
    with pytest.raises(ValueError):
        put([(4, 1.0, "a/b")])


def test_a_commit_is_there_once_and_whole(spark, store):
    path, put, held = store
    assert put([(1, 1.0, "a")], commit="x") and not put([(1, 7.0, "a")], commit="x")
    assert held() == [(1, 1.0, "a")]
    before = versioned.read_table(spark, path, T.StructType.fromDDL(ROW), "part")
    # A writer that dies before its manifest leaves nothing that readers see.
    versioned._write(spark, spark.createDataFrame([(9, 9.0, "a")], ROW), path, "part", None)
    assert held() == [(1, 1.0, "a")]
    put([(2, 2.0, "a")])
    assert held() == [(1, 1.0, "a"), (2, 2.0, "a")] and before.count() == 1  # an open reader keeps its commit
    with pytest.raises(versioned.Conflict):
        versioned._commit(spark, path, versioned.Manifest(2, {}, []))
    assert versioned.vacuum(spark, path) == 2 and held() == [(1, 1.0, "a"), (2, 2.0, "a")]


def test_coverage_comes_with_the_commit(spark, store):
    path, put, _ = store
    key = T.StructField("k", T.LongType())
    put([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b")], cover="k")
    put([(2, 2.0, "b")], cover="k")
    assert sorted(map(tuple, versioned.coverage(spark, path, key, "part").collect())) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "b")]


def test_replacement_refuses_doubled_keys(spark, store):
    path, put, held = store
    put([(1, 1.0, "a")])
    with pytest.raises(ValueError):
        versioned.replace(spark, spark.createDataFrame([(2, 1.0, "a"), (2, 2.0, "b")], ROW), path, "k", "part")
    assert held() == [(1, 1.0, "a")]
    versioned.replace(spark, spark.createDataFrame([(2, 1.0, "b")], ROW), path, "k", "part")
    assert held() == [(2, 1.0, "b")]


def test_replayed_batch_adds_nothing_to_kept_sums(spark):
    path, schema = shared(spark), jobs.schema_of("board string, n long, total decimal(24,2), refreshed long")
    owner = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "o_custkey long, board string")
    batch = lambda rows: spark.createDataFrame(rows, "o_custkey long, o_totalprice double")
    for name, rows in (("batch-0", [(1, 1.5), (3, 2.0)]), ("batch-1", [(2, 0.1), (1, 0.2)]), ("batch-1", [(2, 0.1), (1, 0.2)])):
        jobs.add_sums(batch(rows), owner, path, name)
    got = {r.board: (r.n, float(r.total), r.refreshed) for r in versioned.read_table(spark, path, schema, "board").collect()}
    assert got == {"A": (3, 1.8, 2), "B": (1, 2.0, 1)}  # B was left alone by the second batch


def test_streams_restarted_between_batches_equal_the_batch(spark):
    bars = bars_daily(spark, SF).select("symbol", "date", "high", "low", "close", "volume", "amount").filter("symbol < 4")
    days = [dt.date(1996, 1, 1), dt.date(1997, 6, 1), dt.date(1999, 1, 1)]
    cuts = [F.lit(True), *(F.col("date") >= F.lit(d) for d in days)]
    parts = [bars.filter(a & ~b) for a, b in zip(cuts, [*cuts[1:], F.lit(False)], strict=True)]
    found = jobs.resumed(spark, parts, lambda rows: jobs.stepped(rows, "symbol", jobs.Trailing(), jobs.T01_SCHEMA))
    plain = lambda x: None if x is None or x != x else x
    got = {(r.symbol, r.date): tuple(map(plain, r)) for r in found.collect()}
    for symbol, rows in bars.toPandas().groupby("symbol"):
        want = jobs.trailing_rows(rows.sort_values("date"))
        for x in want.itertuples(index=False):
            assert got[symbol, x.date][2:] == tuple(map(plain, x[1:]))
    ranged = events.with_range(bars_daily(spark, SF)).filter("symbol < 4")
    thirds = [ranged.filter(f"date < '{days[0]}'"), ranged.filter(f"date >= '{days[0]}' AND date < '{days[2]}'"), ranged.filter(f"date >= '{days[2]}'")]
    stream = jobs.resumed(spark, thirds, lambda rows: jobs.stepped(rows, "symbol", jobs.Stepping(events.stream_step, events.STATE_SCHEMA), events.SCHEMA))
    batch = events.detect(bars_daily(spark, SF)).filter("symbol < 4")
    key = lambda r: (r.symbol, r.date)
    assert sorted(stream.collect(), key=key) == sorted(batch.collect(), key=key)


def test_trailing_state_is_fetched_and_put_once_a_batch(spark):
    """However many bars a batch brings; features go on from the kept bars."""
    import datetime as dt

    import pandas as pd

    from marketgrid.streaming import jobs

    class Kept:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = rows, self.calls + 1

    class Handle:
        kept = Kept()

        def getListState(self, name, schema):
            return self.kept

    bars = pd.DataFrame([(dt.date(2020, 1, 1) + dt.timedelta(k), 11.0 + k % 7, 9.0 + k % 5, 10.0 + k % 6, 100.0 + k % 9, 5.0 + k % 4) for k in range(150)], columns=jobs.Trailing.columns)
    processor = jobs.Trailing()
    processor.init(Handle())
    out = pd.concat([x for part in (bars[:70], bars[70:73], bars[73:]) for x in processor.handleInputRows((1,), iter([part]), None)])
    assert Handle.kept.calls == 6 and len(Handle.kept.rows) == jobs.KEPT
    pd.testing.assert_frame_equal(out.drop(columns="symbol").reset_index(drop=True), jobs.trailing_rows(bars))


def test_streamed_bars_are_made_once(spark, monkeypatch):
    """Both parts of the detector's stream are read from stored bars."""
    from marketgrid.streaming import jobs

    monkeypatch.setattr(jobs, "resumed", lambda spark, parts, build: parts)
    for part in jobs.t02_stream_events(spark, "/root/testdata/sf0.001"):
        assert not any("lineitem" in name for name in part.inputFiles())
