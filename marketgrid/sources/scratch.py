"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A local session without it (tests) gets one of its own; on a cluster, where executors don't
    share a machine's folders, its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marketgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables of one operator call in the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        path = f"{self.base}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer read, or all of them at the session's end."""
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.base)
            fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            for name in names or [""]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}") if name else path, True)
        except Exception as gone:  # the session has ended before the interpreter
            if names:
                raise gone
