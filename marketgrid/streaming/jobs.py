"""Structured Streaming counterparts (T01-T09): incremental ingest, roll-ups and stateful features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import events
from ..sources.scratch import Scratch
from ..sources.stores import is_folder, shared
from ..sources.tables import bars_daily, table
from ..sources.versioned import manifest, read_table, upsert


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream; NTZ times become instants, as watermarks need them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    # A file source watches folders: a table that is one file is picked out of its folder by name.
    rows = stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def start(frame: DataFrame, at: str, mode: str = "append"):
    """A stream that appends to ``at``/rows until nothing new is there; its state lies beside them."""
    return (
        frame.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
        .trigger(availableNow=True).start()
    )


def drain(spark: SparkSession, frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the rows that it wrote."""
    at = shared(spark)
    start(frame, at, mode).awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{at}/rows")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held:
    """A key's value state, as a step sees it."""

    def __init__(self, state) -> None:
        self.state, self.update = state, state.update

    @property
    def exists(self) -> bool:
        return self.state.exists()

    @property
    def get(self) -> tuple:
        return tuple(self.state.get())


class Stepping(StatefulProcessor):
    """``step(key, batches, held)`` over one typed value for each key."""

    def __init__(self, step, schema: str) -> None:
        self.step, self.schema = step, T.StructType.fromDDL(schema)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        yield from self.step(key, rows, Held(self.held))

    def close(self) -> None:
        pass


def stepped(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=T.StructType.fromDDL(schema), outputMode="Append", timeMode="None")


def resumed(spark: SparkSession, parts: list[DataFrame], build) -> DataFrame:
    """Rows of ``build(stream)`` when ``parts`` arrive one after the other: each run continues from the saved state of the one before."""
    at, schema = shared(spark), parts[0].schema
    out = None
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # typed state needs it
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        out = build(spark.readStream.schema(schema).parquet(f"{at}/in"))
        start(out, at).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


def halves(bars: DataFrame) -> list[DataFrame]:
    """Bars before and from the middle day on; ``bars`` are read three times, so they should be stored."""
    days = bars.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.date_add("a", F.expr("CAST(datediff(b, a) / 2 AS int)"))).first()[0]
    return [bars.filter(F.col("date") < F.lit(days)), bars.filter(F.col("date") >= F.lit(days))]


def last_of(rows: DataFrame, keys: list[str], time: str, period: str, order: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    """The last row of each key and bucket, emitted once the watermark passes the bucket."""
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, period), *keys)
        .agg(F.max_by(value, F.struct(time, *order)).alias(value), F.count("*").alias("copies"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), *keys, value, "copies")
    )


#: Minutes of the bars that T06 rolls up.
PERIODS = (1, 5, 15, 30, 60)


def roll_up(rows: DataFrame, minutes: int, key: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """Bars of a period from events; a bucket is emitted once the watermark passes it."""
    order = F.struct(time, "event_id")
    return (
        rows.withWatermark(time, "10 minutes")
        .groupBy(F.window(time, f"{minutes} minutes"), key)
        .agg(
            F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
            F.count("*").alias("n"),
        )
        .select(F.lit(minutes).alias("minutes"), F.col("window.start").cast("timestamp_ntz").alias("bucket"), key, "open", "high", "low", "close", "n")
    )


def t05_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, type and minute."""
    return drain(spark, last_of(source(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "1 minute", ["event_id"], "event_id"))


def t06_stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all periods; the streams run side by side."""
    frames = [roll_up(source(spark, sf_dir, "events"), n) for n in PERIODS]
    places = [shared(spark) for _ in PERIODS]
    for query in [start(frame, at) for frame, at in zip(frames, places, strict=True)]:
        query.awaitTermination()
    return spark.read.schema(frames[0].schema).parquet(*(f"{at}/rows" for at in places))


def t02_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector over bars that arrive in two parts; a symbol's saved state continues it."""
    bars = Scratch(spark).write(events.with_range(bars_daily(spark, sf_dir)), "bars")
    return resumed(
        spark, halves(bars),
        lambda rows: stepped(rows, "symbol", Stepping(events.stream_step, events.STATE_SCHEMA), events.SCHEMA),
    )


#: Bars that T01 keeps of each symbol: the longest window and the bar before it.
KEPT = 61
#: What is added before features are rounded, so that halves go up whatever their last bit.
HALF = 1e-9
_T01 = ("ret_1", "ret_5", "ret_20", "ma5", "ma10", "ma20", "ma60", "atr14_ratio", "volatility20", "drawdown20", "drawdown60", "vol_ratio20", "amount_ratio20")
T01_SCHEMA = "symbol long, date date, " + ", ".join(f"{x} double" for x in _T01)


def _windows(x: np.ndarray, n: int, of, lag: int = 0) -> np.ndarray:
    """``of`` over the last ``n`` values that end ``lag`` rows back; not a number until there are so many, or where one is missing."""
    out = np.full(len(x), np.nan)
    if len(x) >= n + lag:
        out[n - 1 + lag :] = of(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)[: len(x) - n + 1 - lag]
    return out


def _back(x: np.ndarray, n: int) -> np.ndarray:
    return np.r_[np.full(min(n, len(x)), np.nan), x[:-n]]


def trailing_rows(bars: pd.DataFrame) -> pd.DataFrame:
    """Trailing features of bars in date order."""
    high, low, close, volume, amount = (bars[c].to_numpy(float) for c in ("high", "low", "close", "volume", "amount"))
    with np.errstate(all="ignore"):
        before, ret = _back(close, 1), close / _back(close, 1) - 1
        true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        found = {
            **{f"ret_{n}": close / _back(close, n) - 1 for n in (1, 5, 20)}, **{f"ma{n}": _windows(close, n, np.mean) for n in (5, 10, 20, 60)},
            "atr14_ratio": _windows(true_range, 14, np.mean) / close, "volatility20": _windows(ret, 20, np.std),
            **{f"drawdown{n}": close / _windows(close, n, np.max) - 1 for n in (20, 60)},
            "vol_ratio20": volume / _windows(volume, 20, np.mean, 1), "amount_ratio20": amount / _windows(amount, 20, np.mean, 1),
        }
    return pd.DataFrame({"date": bars.date.to_numpy(), **{k: np.round(found[k] + HALF, 5) for k in _T01}})


class Trailing(StatefulProcessor):
    """Features of a micro-batch's bars from the last ``KEPT`` bars in state.

    The bars stand in one list, fetched and put in one call each: a call to the state's server costs more than a bar.
    """

    columns = ("date", "high", "low", "close", "volume", "amount")

    def __init__(self) -> None:
        self.kind = T.StructType.fromDDL("date date, high double, low double, close double, volume double, amount double")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.kind)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("date")[list(self.columns)]
        past = list(self.kept.get())
        both = pd.concat([pd.DataFrame([tuple(x) for x in past], columns=self.columns), new], ignore_index=True) if past else new
        self.kept.put(list(both[-KEPT:].itertuples(index=False, name=None)))
        out = trailing_rows(both).iloc[len(both) - len(new) :]
        out.insert(0, "symbol", key[0])
        yield out

    def close(self) -> None:
        pass


def t01_stream_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing features over bars that arrive in two parts."""
    bars = Scratch(spark).write(bars_daily(spark, sf_dir).select("symbol", "date", "high", "low", "close", "volume", "amount"), "bars")
    found = resumed(spark, halves(bars), lambda rows: stepped(rows, "symbol", Trailing(), T01_SCHEMA))
    return found.select("symbol", "date", *(F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in _T01))


def in_batches(spark: SparkSession, parts: list[DataFrame], at: str, land) -> None:
    """Let ``parts`` arrive one after the other; ``land(batch, name)`` takes each micro-batch.  A name comes again where a batch is replayed."""
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        run = stream.writeStream.foreachBatch(lambda batch, number: land(batch, f"batch-{number}"))
        run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def _log(rows: DataFrame, at: str, name: str) -> None:
    """A batch's log rows in a folder of its own, so that a replayed batch is there once."""
    rows.write.mode("overwrite").parquet(f"{at}/log/batch={name}")


def t03_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files of orders upserted batch by batch into a table by month; what a batch brings is new, revised or, by its hash, unchanged.

    The second part repeats every fifth order as it was and every third with another total.
    """
    at, key = shared(spark), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    hashed = lambda x: x.withColumn("hash", F.xxhash64("o_orderkey", "o_totalprice", "month"))
    schema = hashed(rows).schema

    def land(batch: DataFrame, name: str) -> None:
        session = batch.sparkSession
        if name in manifest(session, f"{at}/table").commits:
            return
        held = read_table(session, f"{at}/table", schema, "month").select("o_orderkey", F.col("hash").alias("held"))
        state = F.when(F.col("held").isNull(), "new").when(F.col("held") == F.col("hash"), "unchanged").otherwise("revised")
        known = batch.join(held, "o_orderkey", "left").withColumn("state", state)
        _log(known.groupBy("state").agg(F.count("*").alias("n")), at, name)
        upsert(session, known.filter("state <> 'unchanged'").select(*schema.names), f"{at}/table", ["o_orderkey"], "o_totalprice", "month", name, moves=False)

    again = rows.filter((key % 5 == 0) & (key % 3 != 0)).unionByName(rows.filter(key % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    first = rows.filter((key % 4 != 1) | (key % 3 != 0) & (key % 5 != 0))
    in_batches(spark, [hashed(first), hashed(again)], at, land)
    total = read_table(spark, f"{at}/table", schema, "month").agg(F.count("*").alias("held"), F.round(F.sum("o_totalprice"), 1).alias("total"))
    log = spark.read.schema("state string, n long, batch string").parquet(f"{at}/log").withColumn("batch", F.substring_index("batch", "-", -1).cast("int"))
    return log.crossJoin(F.broadcast(total))  # one row


def t04_late_evidence(spark: SparkSession, sf_dir: str, delay: str = "1 day") -> DataFrame:
    """Evidence after 15:00 counts for the next day; what comes later than ``delay`` behind the latest event seen before goes to a side table.

    Events with even ids arrive first, the others after them, so that some are late.
    """
    at = shared(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.when(F.date_format("ts", "HH:mm:ss") > "15:00:00", F.date_add(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))

    def land(batch: DataFrame, name: str) -> None:
        session, number = batch.sparkSession, int(name.rpartition("-")[2])
        mark = session.read.parquet(f"{at}/mark").filter(F.col("batch") < number).agg(F.max("ts")).first()[0] if number else None
        late = F.lit(False) if mark is None else F.col("ts") < F.lit(mark) - F.expr(f"INTERVAL {delay}")
        batch.select("event_id", "user_id", day.alias("session"), late.alias("late")).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")
        batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{at}/mark/batch={number}")

    in_batches(spark, [rows.filter(F.col("event_id") % 2 == part) for part in (0, 1)], at, land)
    landed = spark.read.parquet(f"{at}/rows").select("event_id", "user_id", "session", F.when(F.col("late"), "side").otherwise("main").alias("target"))
    return landed


BUCKETS = "symbol long, period string, bucket date, open double, high double, low double, close double, volume double, available date"


def _closing_step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    """A symbol's open week and month in state; a bucket is given out by the first bar of a later one."""
    names = ["bucket", "open", "high", "low", "close", "volume"]
    bars = pd.concat(list(batches)).sort_values("date")
    days = pd.to_datetime(bars.date)
    starts = {"week": days - pd.to_timedelta(days.dt.weekday, unit="D"), "month": days - pd.to_timedelta(days.dt.day - 1, unit="D")}
    saved, state, out = (dict(zip(("week", "month"), held.get, strict=True)) if held.exists else {}), [], []
    for period, start_day in starts.items():
        open_bucket = None if saved.get(period) is None else dict(zip(names, saved[period], strict=True))
        for bucket, bar in zip(start_day.dt.date, bars.itertuples(index=False), strict=True):
            if open_bucket is not None and open_bucket["bucket"] == bucket:
                open_bucket.update(high=max(open_bucket["high"], bar.high), low=min(open_bucket["low"], bar.low), close=bar.close, volume=open_bucket["volume"] + bar.volume)
                continue
            if open_bucket is not None:
                out.append((key[0], period, *open_bucket.values(), bar.date))
            open_bucket = {"bucket": bucket, "open": bar.open, "high": bar.high, "low": bar.low, "close": bar.close, "volume": bar.volume}
        state.append(tuple(open_bucket.values()) if open_bucket else None)
    held.update(tuple(state))
    yield pd.DataFrame(out, columns=[part.split()[0] for part in BUCKETS.split(", ")])


def t07_closed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly and monthly bars over daily bars that arrive in two parts, each once a later bucket is seen."""
    bars = bars_daily(spark, sf_dir).select("symbol", "date", "open", "high", "low", "close", "volume")
    one = "struct<bucket:date,open:double,high:double,low:double,close:double,volume:double>"
    found = resumed(
        spark, halves(bars),
        lambda rows: stepped(rows, "symbol", Stepping(_closing_step, f"week {one}, month {one}"), BUCKETS),
    )
    return found.withColumn("volume", F.round("volume", 2))


def t07_closed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's events by type, emitted once the watermark passes it."""
    weekly = (
        source(spark, sf_dir, "events").withWatermark("ts", "0 seconds")
        .groupBy(F.window("ts", "7 days", startTime="4 days"), "event_type").agg(F.count("*").alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("week"), "event_type", "n")
    )
    return drain(spark, weekly)


def t09_daily_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduled run takes the files that are new since the last one; a log row for each run.

    Orders land by year of order; each run upserts its new files and logs how many rows it took.
    """
    at = shared(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"))

    def land(batch: DataFrame, name: str) -> None:
        _log(batch.groupBy("year").agg(F.count("*").alias("n")), at, name)
        upsert(batch.sparkSession, batch, f"{at}/table", ["o_orderkey"], "o_totalprice", "year", name, moves=False)

    in_batches(spark, [rows.filter("year < '1995'"), rows.filter("year >= '1995'")], at, land)
    held = read_table(spark, f"{at}/table", rows.schema, "year").groupBy("year").agg(F.count("*").alias("held"))
    log = spark.read.schema("year string, n long, batch string").parquet(f"{at}/log")
    return log.join(held, "year").select(F.substring_index("batch", "-", -1).cast("int").alias("run"), "year", "n", "held")


def add_sums(batch: DataFrame, owner: DataFrame, path: str, name: str) -> None:
    """Add a batch's observations (o_custkey, o_totalprice) to the kept sums of their boards.

    Only boards with observations in the batch are read and written, and no observation is read again;
    the commit has the batch's name, so a replayed batch adds nothing.
    """
    schema = "board string, n long, total decimal(24,2), refreshed long"
    fresh = batch.join(owner, "o_custkey").groupBy("board").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(24,2)").alias("total"))
    kept = read_table(batch.sparkSession, path, schema_of(schema), "board").select("board", F.col("n").alias("n_before"), F.col("total").alias("total_before"), "refreshed")
    none = lambda x: F.coalesce(x, F.lit(0))
    sums = fresh.join(kept, "board", "left").select(
        "board", (F.col("n") + none("n_before")).alias("n"), (F.col("total") + none("total_before")).cast("decimal(24,2)").alias("total"), (none("refreshed") + 1).cast("long").alias("refreshed")
    )
    upsert(batch.sparkSession, sums, path, ["board"], "refreshed", "board", name, moves=False)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def t08_refresh_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only boards with changed members are refreshed, batch by batch, from their kept sums; orders arrive by part of the month."""
    at = shared(spark)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.least(F.floor((F.dayofmonth("o_orderdate") - 1) / 10), F.lit(2)).alias("part"))
    owner = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("board"))
    in_batches(spark, [rows.filter(F.col("part") == k) for k in range(3)], at, lambda batch, name: add_sums(batch, owner, f"{at}/boards", name))
    kept = read_table(spark, f"{at}/boards", schema_of("board string, n long, total decimal(24,2), refreshed long"), "board")
    return kept.select("board", "n", F.round(F.col("total").cast("double"), 1).alias("total"))


_E = "WITH m AS (SELECT max(ts) AS last FROM events) "
_ROLL = (
    "SELECT CAST({0} AS INTEGER) AS minutes, bucket, user_id, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,"
    " arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL {0} MINUTES, ts) AS bucket FROM events)"
    " GROUP BY bucket, user_id HAVING bucket + INTERVAL {0} MINUTES <= (SELECT last FROM m) - INTERVAL 10 MINUTES"
)
_CLOSED = (
    "SELECT symbol, '{0}' AS period, bucket, open, high, low, close, volume, available FROM (SELECT *, lead(first) OVER (PARTITION BY symbol ORDER BY bucket) AS available FROM ("
    "SELECT symbol, CAST(date_trunc('{0}', date) AS DATE) AS bucket, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,"
    " round(sum(volume), 2) AS volume, min(date) AS first FROM bars GROUP BY 1, 2)) WHERE available IS NOT NULL"
)
_BY = "OVER (PARTITION BY symbol ORDER BY date"
_LAST = _BY + " ROWS BETWEEN {0} PRECEDING AND {1})"


def _full(of: str, x: str, n: int, lag: int = 0) -> str:
    rows = _LAST.format(n - 1 + lag, f"{lag} PRECEDING" if lag else "CURRENT ROW")
    return f"CASE WHEN count({x}) {rows} = {n} THEN {of}({x}) {rows} END"


_T01_SQL = (
    "BARS:, p AS (SELECT *, lag(close) " + _BY + ") AS before FROM bars), r AS (SELECT *, close / before - 1 AS ret, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM p) SELECT symbol, date, "
    + ", ".join(
        f"round({e} + {HALF}, 5) AS {name}"
        for name, e in (
            *((f"ret_{n}", f"close / lag(close, {n}) {_BY}) - 1") for n in (1, 5, 20)), *((f"ma{n}", _full("avg", "close", n)) for n in (5, 10, 20, 60)),
            ("atr14_ratio", f"({_full('avg', 'tr', 14)}) / close"), ("volatility20", _full("stddev_pop", "ret", 20)),
            *((f"drawdown{n}", f"close / ({_full('max', 'close', n)}) - 1") for n in (20, 60)),
            ("vol_ratio20", f"volume / ({_full('avg', 'volume', 20, 1)})"), ("amount_ratio20", f"amount / ({_full('avg', 'amount', 20, 1)})"),
        )
    )
    + " FROM r"
)
ORACLE = {
    "t01_stream_trailing": _T01_SQL,
    "t03_stream_upsert": """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 4 <> 1 OR (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)), b AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0),
h AS (SELECT count(*) AS held, round(sum(coalesce(b.p, a.p)), 1) AS total FROM a FULL JOIN b USING (k)),
l AS (SELECT 'new' AS state, 0 AS batch FROM a UNION ALL SELECT CASE WHEN a.k IS NULL THEN 'new' WHEN a.p = b.p THEN 'unchanged' ELSE 'revised' END, 1 FROM b LEFT JOIN a USING (k))
SELECT state, count(*) AS n, batch, any_value(held) AS held, any_value(total) AS total FROM l, h GROUP BY state, batch""",
    "t04_late_evidence": "SELECT event_id, user_id, CAST(ts AS DATE) + CASE WHEN strftime(ts, '%H:%M:%S') > '15:00:00' THEN 1 ELSE 0 END AS session, CASE WHEN event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 1 DAY THEN 'side' ELSE 'main' END AS target FROM events",
    "t05_stream_dedupe": _E + "SELECT date_trunc('minute', ts) AS bucket, user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS copies FROM events GROUP BY 1, 2, 3 HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT last FROM m) - INTERVAL 1 HOUR",
    "t06_stream_rollup": _E + " UNION ALL ".join(_ROLL.format(n) for n in PERIODS),
    "t07_closed_buckets": "BARS:" + " UNION ALL ".join(_CLOSED.format(p) for p in ("week", "month")),
    "t07_closed_weeks": _E + "SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('week', ts) + INTERVAL 7 DAYS <= (SELECT last FROM m)",
    "t08_refresh_boards": "SELECT c_mktsegment AS board, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "t09_daily_update": "SELECT CAST(strftime(o_orderdate, '%Y') >= '1995' AS INTEGER) AS run, strftime(o_orderdate, '%Y') AS year, count(*) AS n, count(*) AS held FROM orders GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLE} | {"t02_stream_events": t02_stream_events}
