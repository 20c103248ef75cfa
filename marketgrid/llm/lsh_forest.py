"""MinHash near-duplicates by an LSH forest (operator 12).

Each set of word shingles gets ``TREES`` signatures.  A tree is a sorted order of the signatures of
all sets: their first ``BASE`` values name the region, the values after them the place within it.
Neighbours of longest common prefix are candidates first, at whatever depth a region's sets are told
apart; then sets that are still unconnected go up to their regions and meet all that share one.
Candidates are decided on full sets.

A link of similarity J is met unless no tree has the first values of both sets alike, which
happens with probability (1 - J ** BASE) ** TREES: 4 in 10 million at 0.85, less above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join
from .common import read

#: Words in a shingle; sets link when 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 5, 85
#: Sorted orders, values that name a region, and bits kept of each of them.
TREES, BASE, BITS = 20, 4, 14
#: Shingles that meet all hash functions at once.
STEP = 4096

_FUNCTIONS = TREES * BASE
_KEYS = np.arange(1, 2 * _FUNCTIONS + 1, dtype=np.uint64)
_FACTOR = jaccard_join._mix(_KEYS[:_FUNCTIONS] * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFT = jaccard_join._mix(_KEYS[_FUNCTIONS:] * np.uint64(0xC2B2AE3D27D4EB4F))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(_FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, (hashes[None, at : at + STEP] * _FACTOR[:, None] + _SHIFT[:, None]).min(1))
    return jaccard_join._mix(least)


def forest(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """A set's region in each tree, and its place there: values that go deeper, first ones in the higher bits."""
    if jaccard_join.most_apart(len(hashes), percent) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)  # it links with equal sets only
    values = signature(hashes).reshape(TREES, BASE)
    region = np.arange(TREES, dtype=np.uint64)
    for level in range(BASE):
        region = region << np.uint64(BITS) | values[:, level] >> np.uint64(64 - BITS)
    place, deeper = np.zeros(TREES, np.uint64), np.roll(values, -1, axis=0)  # the next tree's values tell apart further
    for level in range(jaccard_join.LEVELS):
        place = place << np.uint64(jaccard_join.LEVEL_BITS) | deeper[:, level] >> np.uint64(64 - jaccard_join.LEVEL_BITS)
    return region.astype(np.int64), place.astype(np.int64)


SCHEME = jaccard_join.Scheme(forest, ordered=True)


def near_duplicates(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (whether it is that one) of each row.

    Equal sets are one node, however many rows hold them.  Rows without words link with nothing and
    are kept; rows without id have a null component and ``kept``, but link others; repeated rows
    have one row each, an empty table none.
    """
    linked = jaccard_join.link(frame, id_col, text_col, width, percent, SCHEME)
    return linked.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
