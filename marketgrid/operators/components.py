"""Connected components of edge tables by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """``node`` and ``label`` (the smallest node it is connected with) of every node of ``edges`` (a, b: long).

    Each round sends every node to its smallest neighbour, follows that pointer twice more, and
    goes on with the edges between what is left, so stars end after one round and chains after a
    logarithm of their length.  Minima are combined before the shuffle; every round's tables are
    written, so nothing is recomputed from the start when an executor is lost.
    """
    left = scratch.write(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
        f"{name}-edges-0",
    )
    label, turn = None, 0
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        up = scratch.write(up, f"{name}-up-{turn}")
        for jump in range(2):
            over = up.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            up = scratch.write(up.join(over, "label").select("node", F.col("higher").alias("label")), f"{name}-up-{turn}-{jump}")
        of_a = up.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = left.join(of_a, "a").join(of_b, "b").filter("la <> lb")
        moved = moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        turn += 1
        left = scratch.write(moved, f"{name}-edges-{turn}")
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-up-{turn - 1}", f"{name}-up-{turn - 1}-0")
        if label is None:
            label = up
        else:
            over = up.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            label = label.join(over, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
            label = scratch.write(label, f"{name}-label-{turn}")
            scratch.drop(f"{name}-label-{turn - 1}" if turn > 2 else f"{name}-up-0-1", f"{name}-up-{turn - 1}-1")
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
