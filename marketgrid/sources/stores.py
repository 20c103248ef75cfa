"""Table stores on plain parquet: upsert, snapshots, run facts, issue sinks and text sources."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import bars_daily, fills, signals, table
from .versioned import coverage, read_table, replace, upsert


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def shared(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; it goes when the session ends."""
    return Scratch(spark).base


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _where(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = _where(spark, path)
    return files.getFileStatus(where).isDirectory()


def append_run(spark: SparkSession, facts: DataFrame, path: str, run: str, expected: int) -> bool:
    """Append a run's facts and publish it only if all are there."""
    facts.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(f"{path}/facts")
    complete = spark.read.parquet(f"{path}/facts").filter(F.col("run_id") == run).count() == expected
    status = spark.range(1).select(F.lit(run).alias("run_id"), F.lit(complete).alias("published"))
    status.write.mode("append").parquet(f"{path}/status")
    return complete


def import_snapshot(spark: SparkSession, rows: DataFrame, path: str, content: list[str]) -> None:
    """Append rows whose content hash is not yet there."""
    hashed = rows.withColumn("snapshot_hash", F.sha2(F.concat_ws("|", *content), 256)).dropDuplicates(["snapshot_hash"])
    if exists(spark, path):
        hashed = hashed.join(spark.read.parquet(path).select("snapshot_hash"), "snapshot_hash", "left_anti")
    hashed.write.mode("append").parquet(path)


#: Symbols whose CSV files are written and read at a time: the driver lists, plans and keeps the names of no more.
FILES = 2000
#: What Spark's writer calls the folder of rows without a symbol.
_UNNAMED = "__HIVE_DEFAULT_PARTITION__"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listed_by(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Folders are listed by so many tasks; by itself each of a few thousand folders gets a task of its own."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(tasks))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_csv_bars(spark: SparkSession, path: str | list[str], base: str | None = None) -> DataFrame:
    """One CSV file or folder for each symbol, headers by alias, symbol from the folder's or the file's name; of some folders below ``base`` only."""
    aliases = {"date": ("date", "trade_date", "day"), "close": ("close", "close_price"), "volume": ("volume", "vol")}
    reader = spark.read.option("header", True)
    raw = (reader.option("basePath", base) if base else reader).csv(path)
    pick = [F.coalesce(*(F.col(a) for a in names if a in raw.columns)).alias(n) for n, names in aliases.items()]
    symbol = F.col("symbol").cast("string") if "symbol" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(symbol.alias("symbol"), *pick).select(
        "symbol", F.try_to_date("date").alias("date"), F.expr("try_cast(close AS double)").alias("close"), F.expr("try_cast(volume AS double)").alias("volume")
    )


def s05_csv_bars(spark, sf_dir):
    """Daily closes written as CSV by symbol and read back through the aliasing source.

    All bars of a symbol are in one task, so that it gets one file however many tasks write; tasks put their
    files in place themselves, as the driver would move the symbols' folders one by one.  Symbols go through
    in parts of about ``FILES``, as the driver holds every file of what is read at once; what was read is kept as a table.
    """
    at, scratch, tasks = shared(spark), Scratch(spark), spark.sparkContext.defaultParallelism
    rows = bars_daily(spark, sf_dir).select("symbol", F.col("date").alias("trade_date"), F.col("close").alias("close_price"), F.col("volume").alias("vol"))
    parts = -(-table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().count() // FILES) or 1
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(parts)))
    numbered.repartition(parts, "part").write.partitionBy("part").parquet(f"{scratch.base}/by-part")
    dealt = spark.read.schema(numbered.schema).parquet(f"{scratch.base}/by-part")
    for k in range(parts):
        own = dealt.filter(F.col("part") == k).drop("part")
        found = [_UNNAMED if r.symbol is None else str(r.symbol) for r in own.select("symbol").distinct().collect()]
        if not found:
            continue
        by_symbol = own.repartition(tasks, "symbol").write.mode("append").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        by_symbol.partitionBy("symbol").csv(at)
        with _listed_by(spark, 4 * tasks):
            read = read_csv_bars(spark, [f"{at}/symbol={x}" for x in found], at)
            read.select(F.col("symbol").cast("long").alias("symbol"), "date", "close").coalesce(tasks).write.mode("append").parquet(f"{scratch.base}/read")
    if not exists(spark, f"{scratch.base}/read"):
        return rows.select("symbol", F.col("trade_date").alias("date"), F.col("close_price").alias("close"))  # no bars, no files
    return spark.read.schema("symbol long, date date, close double").parquet(f"{scratch.base}/read")


def s09_merge_minute(spark, sf_dir):
    """Minute values merged twice: a minute that comes again carries the newer value; the last event of a minute is its value."""
    at = shared(spark)
    order = F.struct("available_at", "event_id")
    minutes = signals(spark, sf_dir).groupBy("symbol", F.date_trunc("minute", "available_at").alias("minute")).agg(F.max_by("value", order).alias("value"), F.max("event_id").alias("event_id"))
    minutes = minutes.withColumn("day", F.date_format("minute", "yyyy-MM"))
    for part in (minutes.filter("event_id % 3 <> 0 OR event_id % 2 <> 0"), minutes.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1)):
        upsert(spark, part, at, ["symbol", "minute"], "event_id", "day", moves=False)
    return read_table(spark, at, minutes.schema, "day").select("symbol", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("value", 4).alias("value"))


def s12_issue_sink(spark, sf_dir):
    """Flat bars reported as issues by two overlapping runs; an issue is there once, by the hash that is its id."""
    at = shared(spark)
    found = bars_daily(spark, sf_dir).filter("high = low").select(F.lit("flat_bar").alias("category"), F.col("symbol").cast("string").alias("entity"), F.col("date").cast("string").alias("day"))
    for run in (found.filter("day < '1997-01-01'"), found):
        import_snapshot(spark, run, at, ["category", "entity", "day"])
    return spark.read.parquet(at).select(F.col("snapshot_hash").alias("issue_id"), "category", "entity", "day")


def s08_upsert(spark, sf_dir):
    """Orders upserted twice: the second write corrects the totals of every third order and moves every 21st to another year; a repeated commit changes nothing."""
    at, key = shared(spark), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"))
    upsert(spark, rows, at, ["o_orderkey"], "o_totalprice", "year", "first")
    again = rows.filter(key % 3 == 0).withColumns({"o_totalprice": F.col("o_totalprice") + 1, "year": F.when(key % 21 == 0, "1990").otherwise(F.col("year"))})
    for _ in range(2):
        upsert(spark, again, at, ["o_orderkey"], "o_totalprice", "year", "second")
    return read_table(spark, at, rows.schema, "year").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "year")


def s08_coverage(spark, sf_dir):
    """Rows of each symbol and month in a store of bars, as its commits left them: bars land by half, the second half repeats the middle month."""
    at = shared(spark)
    rows = bars_daily(spark, sf_dir).select("symbol", "date", "close", F.date_format("date", "yyyy-MM").alias("month"))
    for part in (rows.filter("month <= '1998-06'"), rows.filter("month >= '1998-06'")):
        upsert(spark, part, at, ["symbol", "date"], "close", "month", cover="symbol", moves=False)
    return coverage(spark, at, rows.schema["symbol"], "month")


def s10_snapshot(spark, sf_dir):
    """Customers replaced as a whole: the second run leaves out the excluded ones (odd keys)."""
    at = shared(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    replace(spark, rows, at, "c_custkey", "c_mktsegment", "run-1")
    excluded = rows.filter("c_custkey % 2 = 1").select("c_custkey")
    replace(spark, rows.join(excluded, "c_custkey", "left_anti"), at, "c_custkey", "c_mktsegment", "run-2")
    return read_table(spark, at, rows.schema, "c_mktsegment")


def s11_publish(spark, sf_dir):
    """Two runs' facts appended; only the complete one is published."""
    at = shared(spark)
    facts = table(spark, sf_dir, "labels").select("doc_id", "quality")
    append_run(spark, facts, at, "full", facts.count())
    append_run(spark, facts.filter("doc_id % 2 = 0"), at, "part", facts.count())
    good = spark.read.parquet(f"{at}/status").filter("published").select("run_id")
    return spark.read.parquet(f"{at}/facts").join(good, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))


def s13_import(spark, sf_dir):
    """The same snapshot rows imported twice are there once."""
    at = shared(spark)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), "s_name")
    for _ in range(2):
        import_snapshot(spark, rows, at, ["symbol", "s_name"])
    return spark.read.parquet(at).select("symbol", "s_name")


def s01_scan_symbol(spark, sf_dir, symbol: int = 7, start: str = "1996-01-01", stop: str = "1998-01-01"):
    """One symbol's range; the filters on the raw columns reach the parquet scan."""
    rows = table(spark, sf_dir, "lineitem").filter(f"l_suppkey = {symbol} AND l_shipdate >= TIMESTAMP_NTZ '{start}' AND l_shipdate < TIMESTAMP_NTZ '{stop}'")
    return rows.select(F.col("l_orderkey").alias("order"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("price"))


def s02_scan_batch(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol"))
    return bars_daily(spark, sf_dir).join(wanted, "symbol", "left_semi").select("symbol", "date", "close")


def s03_market_window(spark, sf_dir, start: str = "1997-01-01", stop: str = "1997-04-01"):
    rows = table(spark, sf_dir, "lineitem").filter(f"l_shipdate >= TIMESTAMP_NTZ '{start}' AND l_shipdate < TIMESTAMP_NTZ '{stop}'")
    return rows.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.count_distinct("l_suppkey").alias("symbols"), F.count_if((F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0)).alias("valid")
    )


def s04_scan_as_of(spark, sf_dir, cutoff: str = "1998-06-01 12:00:00"):
    """Bars that were visible at a cutoff (a day's bar from 15:00 on), and how many of a symbol's break the contract: later ones, unverified ones."""
    seen = F.col("date").cast("timestamp") + F.expr("INTERVAL 15 HOURS") <= F.to_timestamp(F.lit(cutoff))
    rows = bars_daily(spark, sf_dir).withColumn("seen", seen)
    return rows.groupBy("symbol").agg(
        F.max(F.when(F.col("seen"), F.col("date"))).alias("last"), F.count_if("seen").alias("n"), F.count_if(~F.col("seen")).alias("not_yet_visible"),
        F.count_if(F.col("seen") & (F.col("verified") == 0)).alias("unverified"),
    )


def s06_minute_range(spark, sf_dir, start: str = "10:00:00", stop: str = "14:30:00"):
    """Minute rows of each user in a slice of the day: range, count, first and last value; the slice is a filter on the scan's rows."""
    clock = F.date_format("ts", "HH:mm:ss")
    rows = table(spark, sf_dir, "events").filter((clock >= start) & (clock < stop))
    order = F.struct("ts", "event_id")
    return rows.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))


#: Minutes of the periods that the minute store keeps.
MINUTE_PERIODS = (1, 5, 60)


def minute_bars(spark, sf_dir) -> DataFrame:
    """Bars of users' events by period, in time order."""
    order = F.struct("available_at", "event_id")
    rows = signals(spark, sf_dir).select("symbol", "available_at", "event_id", "value", F.explode(F.array(*map(F.lit, MINUTE_PERIODS))).alias("minutes"))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("available_at") / (F.col("minutes") * 60)) * F.col("minutes") * 60).cast("timestamp_ntz")
    bars = rows.groupBy(F.col("symbol").alias("code"), F.col("minutes").cast("string").alias("period"), start.alias("at"))
    return bars.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.max("event_id").alias("last_event"))


def minute_slice(spark, path: str, schema, period: str, start: str, stop: str) -> DataFrame:
    """Rows of a period of the store between two times, both included, and whether each code's rows reach over the whole range (``covers``)."""
    low, high = (F.to_timestamp_ntz(F.lit(x)) for x in (start, stop))
    rows = read_table(spark, path, schema, "period", [period])
    reach = rows.groupBy("code").agg(((F.min("at") <= low) & (F.max("at") >= high)).alias("covers"))
    return rows.filter((F.col("at") >= low) & (F.col("at") <= high)).join(reach, "code")


def s06_minute_store(spark, sf_dir, start: str = "2024-01-05 00:00:00", stop: str = "2024-01-20 00:00:00"):
    """The minute store by code and period: bars merged in two overlapping parts, then a range of each period by code."""
    at, bars = shared(spark), minute_bars(spark, sf_dir)
    for part in (bars.filter("dayofmonth(at) <= 15"), bars.filter("dayofmonth(at) >= 10")):
        upsert(spark, part, at, ["code", "period", "at"], "last_event", "period", moves=False)
    slices = [minute_slice(spark, at, bars.schema, str(p), start, stop) for p in MINUTE_PERIODS]
    found = slices[0]
    for more in slices[1:]:
        found = found.unionByName(more)
    return found.groupBy("code", "period", "covers").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("high").alias("high"), F.max_by("close", "at").alias("close"))


def s14_projection(spark, sf_dir):
    props = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", "event_type", props["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


def s15_latest_status(spark, sf_dir):
    rows = fills(spark, sf_dir)
    last = rows.groupBy("account").agg(F.max_by("side", F.struct("date", "fill_id")).alias("status"), F.count("*").alias("n"))
    return last.filter("status = 'SELL'").select("account", "n")


ORACLE = {
    "s05_csv_bars": "BARS:SELECT symbol, date, close FROM bars",
    "s08_upsert": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice, CASE WHEN o_orderkey % 21 = 0 THEN '1990' ELSE strftime(o_orderdate, '%Y') END AS year FROM orders",
    "s08_coverage": "BARS:SELECT symbol, strftime(date, '%Y-%m') AS month, count(*) AS rows FROM bars GROUP BY 1, 2",
    "s09_merge_minute": """SELECT symbol, minute, round(value + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END, 4) AS value FROM (SELECT user_id AS symbol, date_trunc('minute', ts) AS minute,
  arg_max(value, (ts, event_id)) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2)""",
    "s12_issue_sink": "BARS:SELECT sha256('flat_bar|' || symbol || '|' || date) AS issue_id, 'flat_bar' AS category, CAST(symbol AS VARCHAR) AS entity, CAST(date AS VARCHAR) AS day FROM bars WHERE high = low",
    "s10_snapshot": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0",
    "s11_publish": "SELECT 'full' AS run_id, count(*) AS n FROM labels",
    "s13_import": "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name FROM supplier",
    "s01_scan_symbol": 'SELECT l_orderkey AS "order", CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price FROM lineitem WHERE l_suppkey = 7 AND l_shipdate >= TIMESTAMP \'1996-01-01\' AND l_shipdate < TIMESTAMP \'1998-01-01\'',
    "s02_scan_batch": "BARS:SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
    "s03_market_window": "SELECT CAST(l_shipdate AS DATE) AS date, count(DISTINCT l_suppkey) AS symbols, count(*) FILTER (l_quantity > 0 AND l_extendedprice > 0) AS valid FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1",
    "s04_scan_as_of": "BARS:, s AS (SELECT *, CAST(date AS TIMESTAMP) + INTERVAL 15 HOURS <= TIMESTAMP '1998-06-01 12:00:00' AS seen FROM bars) SELECT symbol, max(date) FILTER (seen) AS last, count(*) FILTER (seen) AS n, count(*) FILTER (NOT seen) AS not_yet_visible, count(*) FILTER (seen AND verified = 0) AS unverified FROM s GROUP BY symbol",
    "s06_minute_range": "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE strftime(ts, '%H:%M:%S') >= '10:00:00' AND strftime(ts, '%H:%M:%S') < '14:30:00' GROUP BY user_id",
    "s06_minute_store": """WITH b AS (SELECT user_id AS code, CAST(m AS VARCHAR) AS period, time_bucket(to_minutes(CAST(m AS INTEGER)), ts) AS t, max(value) AS high, arg_max(value, (ts, event_id)) AS close FROM events, (VALUES (1), (5), (60)) p(m) GROUP BY 1, 2, 3),
r AS (SELECT code, period, min(t) <= TIMESTAMP '2024-01-05' AND max(t) >= TIMESTAMP '2024-01-20' AS covers FROM b GROUP BY 1, 2)
SELECT code, period, covers, count(*) AS n, min(t) AS first, max(t) AS last, max(high) AS high, arg_max(close, t) AS close FROM b JOIN r USING (code, period) WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL""",
    "s14_projection": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events",
    "s15_latest_status": "SELECT account, n FROM (SELECT o_custkey AS account, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END, (CAST(o_orderdate AS DATE), o_orderkey)) AS status, count(*) AS n FROM orders GROUP BY 1) WHERE status = 'SELL'",
}
QUERIES = {name: globals()[name] for name in ORACLE}
