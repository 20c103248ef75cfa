"""What the training-data operators share: row-wise Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import Scratch as Scratch

#: Where the vocabulary files of public tokenizers lie on every node.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    spark_schema = T.StructType.fromDDL(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


def map_rows(
    frame: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., tuple]], chunk: int = 500
) -> DataFrame:
    """One output row for each input row: ``make()`` gives each task its row function.

    Only ``columns`` are read.  Rows go through Arrow ``chunk`` at a time, so that a task holds the
    results of few rows, however long their texts are.
    """
    spark_schema, schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                values = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), schema, strict=True)], schema=schema
                )

    return frame.select(*columns).mapInArrow(run, spark_schema)


def flat_map_rows(
    frame: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., list[tuple]]], chunk: int = 200
) -> DataFrame:
    """As :func:`map_rows` with any number of output rows for each input row."""
    spark_schema, schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                values = [y for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for y in row(*x)]
                if values:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), schema, strict=True)],
                        schema=schema,
                    )

    return frame.select(*columns).mapInArrow(run, spark_schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, column: str, parts: int) -> DataFrame:
    """Deal rows out evenly over at least ``parts`` tasks, whatever their keys."""
    return frame.repartition(parts, F.xxhash64(column)) if parts > 1 else frame
