"""Best-fit packing of token sequences (operator 9)."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import kind
from .common import Scratch, arrow_schema, read, vocabulary_path
from .ranks import encoder, ranks_suffice

CAPACITY = 2048
END_ID = 0


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram ``{length: pieces}``.

    Bins that are filled alike are one group, so the work depends on the number of lengths and not
    on the number of pieces.  Returns rows (length, rank_from, rank_to, first sequence, pieces in
    each sequence, offset): the pieces with such ranks among their length go, ``per`` to a
    sequence, to consecutive sequences, the first of them at ``offset``.
    """
    plan, free, made = [], {}, 0  # free: room left -> [(first sequence, sequences)]
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first = capacity, made
                bins = -(-left // (capacity // length))
                made += bins
            per = room // length
            full = min(bins, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < bins and left:  # fewer than `per` remain; so they share one bin
                plan.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, bins - full)
    return plan


def pieces(
    frame: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int
) -> DataFrame:
    """One row for each piece, with the task that made it and its rank there among pieces of its length."""
    ddl = f"{id_col} {kind(frame, id_col)}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    spark_schema, schema = arrow_schema(ddl)
    by_ranks = ranks_suffice(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, task, seen = encoder(vocabulary, by_ranks), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for ident, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = pack(text or "") + end
                total = len(packed) // 4
                stop = (total - 1) % capacity + 1
                start = piece = 0
                while start < total:
                    crc = zlib.crc32(memoryview(packed)[4 * start : 4 * stop])
                    out.append((ident, piece, start, stop - start, crc, task, seen[stop - start]))
                    seen[stop - start] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    return frame.select(id_col, text_col).mapInArrow(run, spark_schema)


def pack(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Assign every text, tokenised and closed with ``end_id``, a place in sequences of ``capacity`` tokens.

    The driver sees the histogram of lengths (at most ``capacity`` rows) and plans best-fit
    decreasing over its counts.  A piece's rank within its length is its rank within its task plus
    the counts of the tasks before, and the plan turns rank into sequence and offset, so no length,
    however common, meets in one task.  Null or empty texts are pieces of one token; repeated rows
    are packed one by one; an empty table gives no rows.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark)
    made = scratch.write(
        pieces(frame, id_col, text_col, vocabulary or vocabulary_path(), capacity, end_id), "pieces"
    )
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(
        {
            length: tuple(np.array(c) for c in zip(*rows, strict=True))
            for length, rows in _by_length(plan_best_fit(histogram, capacity)).items()
        }
    )
    ddl = f"{id_col} {kind(frame, id_col)}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    spark_schema, schema = arrow_schema(ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = plan.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                of = np.flatnonzero(length == value)
                low, _, first, per, used = segments[int(value)]
                k = np.searchsorted(low, rank[of], "right") - 1
                inside = rank[of] - low[k]
                sequence[of] = first[k] + inside // per[k]
                offset[of] = used[k] + inside % per[k] * value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema
            )

    ranked = made.join(offsets, ["length", "task"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank")
    )
    return ranked.mapInArrow(place, spark_schema)


def _by_length(plan: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for length, *row in plan:
        out.setdefault(length, []).append(tuple(row))
    return out


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
