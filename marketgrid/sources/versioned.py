"""Tables of versioned partitions behind a manifest (S08-S10): readers see one commit whole, writers swap it by one rename.

A commit writes the partitions that it touches, and what they hold by coverage key, into folders of its
own, and then one small manifest that says for each partition which folder is live.  The manifest
is written aside and renamed to the next number; whoever finds the number taken has lost and starts
over.  What readers have open stays where it is; folders that no manifest needs go by :func:`vacuum`.  A
commit may carry an id: one that the table has seen already changes nothing, so a run after a crash, or a
replayed batch, may simply be repeated.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a partition's value may consist of, as it names a folder.
PLAIN = re.compile(r"[A-Za-z0-9_.\-]+")


@dataclass(frozen=True)
class Manifest:
    """A commit: its number, the folder that is live for each partition, and the ids of the commits up to it."""

    number: int = 0
    live: dict[str, str] = field(default_factory=dict)
    commits: list[str] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another writer has committed in between."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The latest commit; an empty one for a table that isn't there."""
    numbers = [int(n) for n in _names(spark, f"{path}/manifests") if n.isdigit()]
    if not numbers:
        return Manifest()
    files, where = _files(spark, f"{path}/manifests/{max(numbers):010d}")
    stream = files.open(where)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, made: Manifest) -> None:
    aside, target = f"{path}/manifests/.{uuid.uuid4().hex}", f"{path}/manifests/{made.number:010d}"
    files, where = _files(spark, aside)
    out = files.create(where)
    out.write(bytearray(json.dumps({"number": made.number, "live": made.live, "commits": made.commits}).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else files.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(where, jvm.org.apache.hadoop.fs.Path(target), none)  # fails where the number is taken
    except Exception as taken:
        files.delete(where, False)
        raise Conflict(f"commit {made.number} of {path} was taken") from taken


def _paths(path: str, kind: str, live: dict[str, str], partition: str, of: list[str] | None = None) -> list[str]:
    return [f"{path}/{kind}/commit={folder}/{partition}={value}" for value, folder in sorted(live.items()) if of is None or value in of]


def read_table(spark: SparkSession, path: str, schema: T.StructType, partition: str, of: list[str] | None = None, kind: str = "data") -> DataFrame:
    """The rows of the latest commit, of all partitions or of some."""
    paths = _paths(path, kind, manifest(spark, path).live, partition, of)
    if not paths:
        return spark.createDataFrame([], schema)
    of_file = T.StructType([*(f for f in schema if f.name != partition), T.StructField(partition, T.StringType()), T.StructField("commit", T.StringType())])
    rows = spark.read.schema(of_file).option("basePath", f"{path}/{kind}").parquet(*paths)
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def coverage(spark: SparkSession, path: str, key: T.StructField, partition: str) -> DataFrame:
    """Rows of each coverage key and partition, as of the latest commit."""
    schema = T.StructType([key, T.StructField("rows", T.LongType()), T.StructField(partition, T.StringType())])
    return read_table(spark, path, schema, partition, kind="coverage")


def _write(spark: SparkSession, rows: DataFrame, path: str, partition: str, cover: str | None) -> tuple[str, list[str]]:
    """Write a commit's folders; its name and the partitions in it."""
    folder = uuid.uuid4().hex
    rows.write.partitionBy(partition).parquet(f"{path}/data/commit={folder}")
    held = [n.partition("=")[2] for n in _names(spark, f"{path}/data/commit={folder}") if n.startswith(f"{partition}=")]
    if cover and held:
        written = read_folder(spark, path, folder, rows.schema, partition)
        written.groupBy(cover, partition).agg(F.count("*").alias("rows")).write.partitionBy(partition).parquet(f"{path}/coverage/commit={folder}")
    return folder, held


def read_folder(spark: SparkSession, path: str, folder: str, schema: T.StructType, partition: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/data/commit={folder}").parquet(f"{path}/data/commit={folder}")


def upsert(
    spark: SparkSession, new: DataFrame, path: str, keys: list[str], order: str, partition: str, commit: str | None = None, cover: str | None = None, moves: bool = True
) -> bool:
    """The later write wins; only partitions that the new rows touch are rewritten, and one rename shows them. False if ``commit`` was there already.

    Of new rows with one key the one of highest ``order`` counts.  A key whose partition changes leaves
    the old one (with ``moves`` off, keys are known to stay where they are, and only the partitions of new rows
    are read).  Partitions, of which the driver keeps the names, are as many as a table's days or months.
    """
    was = manifest(spark, path)
    if commit is not None and commit in was.commits:
        return False
    schema = new.schema
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order)))
    touched = {r[0] for r in new.select(F.col(partition).cast("string")).distinct().collect()}
    if odd := [x for x in touched if x is None or not PLAIN.fullmatch(x)]:
        raise ValueError(f"{partition} can't name a folder: {odd[:3]}")
    if moves and was.live:
        elsewhere = read_table(spark, path, schema, partition).join(new.select(*keys).distinct(), keys, "left_semi")
        touched |= {r[0] for r in elsewhere.select(F.col(partition).cast("string")).distinct().collect()}
    old = read_table(spark, path, schema, partition, [x for x in touched if x in was.live])
    both = new.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)))
    folder, held = _write(spark, both.withColumn("__k", first).filter("__k = 1").drop("__k", "__new"), path, partition, cover)
    live = {k: v for k, v in was.live.items() if k not in touched} | dict.fromkeys(held, folder)
    _commit(spark, path, Manifest(was.number + 1, live, [*was.commits, *([commit] if commit else [])]))
    return True


def replace(spark: SparkSession, rows: DataFrame, path: str, key: str, partition: str, commit: str | None = None, cover: str | None = None) -> bool:
    """A whole new content, shown once its keys are known to be unique."""
    was = manifest(spark, path)
    if commit is not None and commit in was.commits:
        return False
    folder, held = _write(spark, rows, path, partition, cover)
    doubled = read_folder(spark, path, folder, rows.schema, partition).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if doubled:
        raise ValueError(f"{key} is not unique in the new content of {path}")
    _commit(spark, path, Manifest(was.number + 1, dict.fromkeys(held, folder), [*was.commits, *([commit] if commit else [])]))
    return True


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that the latest commit doesn't need; how many they were.  No writer may be at work."""
    needed, gone = set(manifest(spark, path).live.values()), 0
    for kind in ("data", "coverage"):
        for name in _names(spark, f"{path}/{kind}"):
            if name.partition("=")[2] not in needed:
                files, where = _files(spark, f"{path}/{kind}/{name}")
                gone += files.delete(where, True)
    return gone
