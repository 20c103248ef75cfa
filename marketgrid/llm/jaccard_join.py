"""Exact Jaccard self-join of shingle sets (operator 7).

Size-banded tiles: a set's band fixes a number of segments into which hashing deals its shingles.
Sets that link differ in so few shingles that some segment is the same in both, so sets that share
no (band, segment, contents) tile are never compared.  Tiles that hang together form a group, and
groups are compared in blocks of bounded size: bits of hashed bitmaps bound each pair's overlap from
above, what is left is decided by intersecting sorted arrays, and what is already tied together is
not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Scratch, arrow_schema, read

#: Words in a shingle; sets link when 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 4, 85
#: Sets that a comparing task holds from either side of a large group, and pivots that all its tasks share.
BLOCK, PIVOTS = 256, 4
#: Blocks that a task takes at most where sets outside a group's main component meet all others, and characters of a task's texts.
OPEN_BLOCKS, TASK_CHARS = 4, 8_000_000
#: Texts for each set of a group's grid beyond which bitmaps meet first, and how many times ``BLOCK`` of them a task holds from either side.
WIDE, SKETCH_BLOCKS = 8, 8
#: Sets of small groups that one task takes one group after the other.
SMALL_PER_TASK = 400
#: Least and most bits of a bitmap; in between, four for each shingle of the largest set at hand.  Cells of bitmaps that are spread out at once.
BITS, CELLS = (1024, 65536), 1 << 22
#: Least bits of a set's own bitmap; beyond, two to four for each of its shingles.
SKETCH_BITS = 64

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``width`` are one shingle, none give none."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total + hashes[k : len(words) - n + 1 + k] * _M[k % 4] + np.uint64(k))
    return np.unique(total)


def _slots(limit: int) -> list[int]:
    """Largest set size of each band."""
    out = [8]
    while out[-1] < limit:
        out.append(out[-1] * 3 // 2)
    return out


def most_apart(size: int, percent: int = PERCENT) -> int:
    """Most shingles by which a set of ``size`` and one at least as large that it links with differ."""
    return (100 - percent) * size // percent


def tiles(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """64-bit names of a set's tiles.

    In a band for sets of at most N shingles there are ``most_apart(N) + 1`` segments and a tenth
    more.  Each differing shingle spoils one segment at most.  A set of n shingles may leave out
    ``segments - 1 - most_apart(min(n, N))`` segments and still share one with every partner, if both
    leave out by the same order; it leaves out those of fewest shingles, which many unrelated sets
    share.  A set also goes to the band below when a partner may lie there.
    """
    n = len(hashes)
    if most_apart(n, percent) == 0:
        return np.empty(0, np.int64)  # it links with equal sets only
    slots, out = _slots(n), []
    for band in {len(slots) - 1, len(slots) - 2}:
        if band < 0 or percent * n > 100 * slots[band]:
            continue
        top = slots[band]
        fewest = most_apart(top, percent) + 1
        segments = fewest + -(-fewest // 10)
        where = (_mix(hashes + np.uint64(band)) % np.uint64(segments)).astype(np.int64)
        sizes = np.bincount(where, minlength=segments)
        order = np.argsort(where, kind="stable")
        sums = np.zeros(segments, np.uint64)
        filled = np.flatnonzero(sizes)
        sums[filled] = np.add.reduceat(_mix(hashes[order] ^ _M[1]), (np.cumsum(sizes) - sizes)[filled])
        spare = segments - 1 - most_apart(min(n, top), percent)
        least = next((c for c in (3, 2, 1) if (sizes < c).sum() <= spare), 0)
        used = np.flatnonzero(sizes >= least)
        out.append(_mix(sums[used] + _mix(used.astype(np.uint64) * _M[2] + np.uint64((band + 1) * int(_M[3]) % 2**64))))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


#: What tells texts apart that share an id, and stands for the id where there is none.
KEY = "__key"


def _keyed(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident = F.col(id_col).cast("long")
    return frame.select(ident.alias("id"), F.coalesce(ident, F.xxhash64(text_col)).alias(KEY), F.col(text_col).alias("text"))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


@dataclass(frozen=True)
class Scheme:
    """Where sets meet that may link: ``name`` gives a set's tiles and, if ``ordered``, its place in the order within each of them."""

    name: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray | None]]
    ordered: bool = False


BANDS = Scheme(lambda hashes, percent: (tiles(hashes, percent), None))


def _sets(keyed: DataFrame, width: int, percent: int, scheme: Scheme) -> DataFrame:
    places = ", places array<long>" if scheme.ordered else ""
    spark_schema, schema = arrow_schema(f"id long, {KEY} long, n_shingles long, h1 long, h2 long, tiles array<long>{places}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, digests, named, placed = [], [], [], []
                for text in batch.column(2).to_pylist():
                    hashes = shingles(text, width)
                    n.append(len(hashes))
                    digests.append(_digest(hashes))
                    of, places = scheme.name(hashes, percent)
                    named.append(of)
                    placed.append(places)
                arrays = [named, placed] if scheme.ordered else [named]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                        *(pa.array(x, pa.int64()) for x in zip(*digests, strict=True)), *(pa.array(x, schema.field("tiles").type) for x in arrays),
                    ],
                    schema=schema,
                )

    return keyed.mapInArrow(run, spark_schema)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of each tile's sets to its first one; the first sets of a task's outer tiles, which may go on elsewhere.

    Rows come sorted by tile, place and set, so a task holds one batch at a time.  Where sets have
    places, those that are next to each other there are given besides.
    """
    outer, tile_before, first_before, held = None, 0, 0, np.empty((3, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if batch.num_columns == 3:
            rows = np.concatenate([held, np.stack([tile, node, batch.column(2).to_numpy()])], axis=1)
            yield _near(rows)
            held = rows[:, -3:]
        new = np.r_[outer is None or tile[0] != tile_before, tile[1:] != tile[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(tile)), -1))
        first = np.where(at < 0, first_before, node[at])
        ties = np.stack([first, node])[:, first != node]
        if ties.shape[1]:
            a, b = np.unique(ties, axis=1)
            yield _rows(np.zeros(len(a), np.int64), "tie", a, b)
        outer = outer or (tile[0], node[0])
        tile_before, first_before = tile[-1], first[-1]
    if outer is not None:
        ends, sets = np.array([outer[0], tile_before]), np.array([outer[1], first_before])
        yield _rows(ends, "outer", sets, sets)


#: Levels that the places within a tile have, and bits of each.
LEVELS, LEVEL_BITS = 4, 15


def _near(rows: np.ndarray) -> pa.RecordBatch:
    """For each set of sorted (tile, node, place) the neighbour with which it shares the longest prefix.

    How deep that is depends on how many sets stand around it.
    """
    tile, node, place = rows
    apart, depth = place[1:] ^ place[:-1], np.full(len(place) - 1, LEVELS, np.int64)
    for level in range(LEVELS):
        depth[(apart >> (LEVEL_BITS * level)) != 0] = LEVELS - 1 - level
    shared = np.r_[0, np.where(tile[1:] == tile[:-1], depth + 1, 0), 0]
    with_next = (shared[1:-1] > 0) & ((shared[1:-1] >= shared[:-2]) | (shared[1:-1] >= shared[2:])) & (node[1:] != node[:-1])
    a, b = np.minimum(node[1:], node[:-1])[with_next], np.maximum(node[1:], node[:-1])[with_next]
    return _rows(np.zeros(len(a), np.int64), "near", a, b)


def _rows(tile: np.ndarray, what: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(tile), pa.array([what] * len(a), pa.string()), pa.array(a), pa.array(b)]
    return pa.RecordBatch.from_arrays(columns, names=["tile", "what", "a", "b"])


class _Ties:
    """Union-find over the sets of a task."""

    def __init__(self) -> None:
        self.root: dict = {}

    def find(self, x):
        root = self.root
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    def tie(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[x] = y
        return x != y


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Hashed bitmaps of sets as rows of zeros and ones."""
    out = np.zeros((len(sets), width), np.float32)
    for k, hashes in enumerate(sets):
        out[k, (hashes % np.uint64(width)).astype(np.int64)] = 1
    return out


def candidates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a left and a right set whose bitmaps leave room for a link, at most ``BLOCK`` by ``BLOCK`` sets at a time."""
    width, largest = BITS[0], max((len(sets[k]) for k in (*left, *right)), default=0)
    while width < BITS[1] and width < 4 * largest:
        width *= 2
    size, block = np.array([len(x) for x in sets], np.int64), min(BLOCK, CELLS // width)
    for a in range(0, len(left), block):
        rows = left[a : a + block]
        bits = bitmaps([sets[k] for k in rows], width)
        for b in range(0, len(right), block):
            columns = right[b : b + block]
            other = bits if columns is rows else bitmaps([sets[k] for k in columns], width)
            for i, j in may_link(bits, size[rows], other, size[columns], percent):
                yield int(rows[i]), int(columns[j])


def may_link(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose bit counts leave room for a link.

    Each bit that only one of two bitmaps has is a shingle that the other set lacks.
    """
    common = left @ right.T
    most = np.minimum(
        n_left[:, None] - (left.sum(1)[:, None] - common), n_right[None, :] - (right.sum(1)[None, :] - common)
    )
    return np.argwhere(100 * most >= percent * (n_left[:, None] + n_right[None, :] - most))


def sketch(hashes: np.ndarray) -> bytes:
    """A set's hashed bitmap, of a power of two bits, so that wider ones fold to narrower ones."""
    width = SKETCH_BITS
    while width < BITS[1] and width < 2 * len(hashes):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(hashes % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of packed bitmaps at a width of ``size`` bytes: halves laid over each other."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def sketches_may_link(left: list[bytes], n_left: np.ndarray, right: list[bytes], n_right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs whose bitmaps leave room for a link, as arrays; a pair is held against each other at the narrower one's width."""
    of_left, of_right = (np.array([len(x) for x in side]) for side in (left, right))
    for a in np.unique(of_left):
        rows = np.flatnonzero(of_left == a)
        for b in np.unique(of_right):
            columns = np.flatnonzero(of_right == b)
            x, y = n_left[rows], n_right[columns]
            if 100 * x.max() < percent * y.min() or 100 * y.max() < percent * x.min():
                continue
            size = min(a, b)
            block = CELLS // (8 * size)
            for i in range(0, len(rows), block):
                one = _spread([left[k] for k in rows[i : i + block]], size)
                for j in range(0, len(columns), block):
                    other = _spread([right[k] for k in columns[j : j + block]], size)
                    found = may_link(one, x[i : i + block], other, y[j : j + block], percent)
                    yield rows[i + found[:, 0]], columns[j + found[:, 1]]


def _spread(packed: list[bytes], size: int) -> np.ndarray:
    bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(folded(bits, size), axis=1, bitorder="little").astype(np.float32)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compare(width: int, percent: int):
    """Ties among the sets of each group of a task; with ``asked`` rows, only those against all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("label", sort=False):
            part = part.drop_duplicates(["node", "text", "asked"])
            sets = [shingles(t, width) for t in part.text]
            own = [_digest(s)[0] == h for s, h in zip(sets, part.h1, strict=True)]  # not another text of the id
            sets, part = [s for s, keep in zip(sets, own, strict=True) if keep], part[own]
            nodes, tied, asked = part.node.tolist(), _Ties(), part.asked.to_numpy()
            for node, before in zip(nodes, part.tied, strict=True):
                tied.tie(("node", node), ("tied", before))
            left = np.flatnonzero(asked) if asked.any() else np.arange(len(sets))
            right = np.flatnonzero(~asked) if asked.any() else left
            for x, y in candidates(sets, left, right, percent):
                if not asked.any() and x >= y or nodes[x] == nodes[y]:
                    continue
                a, b = ("node", nodes[x]), ("node", nodes[y])
                if tied.find(a) != tied.find(b) and linked(sets[x], sets[y], percent):
                    tied.tie(a, b)
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _ties(scratch: Scratch, work: DataFrame, texts: DataFrame, name: str, width: int, percent: int) -> DataFrame:
    """Linking pairs (a < b) with the same components, from rows (task, label, node, tied, asked)."""
    full = work.join(texts.drop("chars"), "node")
    edges = full.groupBy("task").applyInPandas(_compare(width, percent), "a long, b long")
    return scratch.write(edges, name)


def _piece(of: Column, pieces: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed)), pieces)


def link(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, scheme: Scheme = BANDS
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of each row.

    Equal sets are one node from the start, so thousands of copies cost one comparison.  Rows without
    words link with nothing.  Rows without id have a null component but link others; rows that
    repeat an id with another text are judged by their own text.  An empty table gives no rows.
    """
    rows, classes = _linked(frame, id_col, text_col, width, percent, scheme)
    named = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    joined = rows.join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", named.alias("component_id"))


def _linked(
    frame: DataFrame, id_col: str, text_col: str, width: int, percent: int, scheme: Scheme = BANDS
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n_shingles, h1, h2), and classes of equal sets (c1, c2) with their component.

    ``component`` is its smallest id, ``winner`` the first of its sets by (no id, id, digest).
    """
    spark = frame.sparkSession
    scratch = Scratch(spark)
    keyed = _keyed(frame, id_col, text_col)
    made = scratch.write(_sets(keyed, width, percent, scheme), "sets")
    known = made.filter("n_shingles > 0")
    by_set = known.groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.min(F.struct(F.col("id").isNull().alias("none"), F.col(KEY).alias("key"))).getField("key").alias("rep")
    )
    classes = scratch.write(by_set.withColumn("node", F.monotonically_increasing_id()), "classes")
    one = classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep", "node")
    met = F.explode(F.arrays_zip("tiles", "places") if scheme.ordered else F.arrays_zip("tiles"))
    named = (
        known.filter(F.size("tiles") > 0)
        .join(one, (F.col(KEY) == F.col("rep")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
        .select(met.alias("met"), "node")
        .select(F.col("met.tiles").alias("tile"), "node", *([F.col("met.places").alias("place")] if scheme.ordered else []))
    )
    # Ranges of (tile, place, node) are even however many sets share a tile.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tile", "place", "node"] if scheme.ordered else ["tile", "node"]
    ranges = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.write(ranges.mapInArrow(_within, "tile long, what string, a long, b long"), "found")
    slim = scratch.write(made.drop("tiles", "places", KEY), "slim")
    outer = found.filter("what = 'outer'").select("tile", "a")  # two rows for each task
    across = outer.join(outer.groupBy("tile").agg(F.min("a").alias("b")), "tile").filter("a <> b")
    group = components(scratch, found.filter("what = 'tie'").select("a", "b").union(across.select("a", "b")), "groups")
    near = components(scratch, found.filter("what = 'near'").select("a", "b"), "near") if scheme.ordered else None
    # Texts travel once, and only those of sets that share a tile are kept at hand.
    wanted = group.select("node").join(classes.select("node", "rep", "h1"), "node")
    texts = scratch.write(wanted.join(keyed.hint("merge"), F.col("rep") == F.col(KEY)).select("node", "h1", "text", F.length("text").alias("chars")), "texts")
    scratch.drop("found")
    sized = _sized(scratch, group, texts)
    edges = _first_ties(scratch, sized, near, texts, width, percent)
    label = components(scratch, edges, "linked")
    more = _open_ties(scratch, sized, label, named, texts, width, percent)
    if more is not None:
        label = components(scratch, edges.union(more), "linked-again")
    scratch.drop("texts", "sets")
    tied = classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = tied.groupBy("label").agg(
        F.min("first").alias("component"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "h1", "h2")).alias("winner")
    )
    of = tied.join(whole, "label").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component", "winner")
    return slim, scratch.write(of, "named")


def _sized(scratch: Scratch, group: DataFrame, texts: DataFrame) -> DataFrame:
    """Members (label, node, chars) of groups with their group's sets ``n``, ``pieces``, and whether it is too ``big`` for one task."""
    chars = texts.groupBy("node").agg(F.max("chars").alias("chars"))
    members = scratch.write(group.join(chars, "node", "left").withColumn("chars", F.coalesce("chars", F.lit(0))), "members")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    pieces = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all_chars") / TASK_CHARS))
    return scratch.write(members.join(sizes.withColumn("pieces", pieces).withColumn("big", F.col("pieces") > 1), "label"), "sized")


def _first_ties(scratch: Scratch, sized: DataFrame, near: DataFrame | None, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All links of small groups; of large ones those within a piece and with the group's pivots.

    Neighbours in an order share a piece where there are orders.
    """
    small = sized.filter("not big").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).first()
    tasks = max(1, small["n"] // SMALL_PER_TASK, (small["chars"] or 0) // TASK_CHARS)
    big = sized.filter("big")
    # Parts of a group that are too large for a piece themselves are dealt by set.
    unit = F.col("node")
    if near is not None:
        beside = near.select("node", F.col("label").alias("near"))
        kept = beside.join(beside.groupBy("near").agg(F.count("*").alias("m")), "near").filter(f"m <= {BLOCK // 2}").drop("m")
        big, unit = big.join(kept, "node", "left"), F.coalesce("near", "node")
    inside = sized.filter("not big").select(_piece(F.col("label"), F.lit(tasks), 1).alias("task"), "label", "node")
    members = big.select(F.xxhash64("label", _piece(unit, F.col("pieces"), 2)).alias("task"), "label", "node")
    pivots = sized.filter("big").groupBy("label", "pieces").agg(
        *(F.min_by("node", F.xxhash64("node", F.lit(3 + k))).alias(f"p{k}") for k in range(PIVOTS))
    )
    pivots = pivots.select(
        "label", F.explode(F.expr("sequence(0L, pieces - 1)")).alias("piece"), F.array(*(f"p{k}" for k in range(PIVOTS))).alias("p")
    ).select(F.xxhash64("label", "piece").alias("task"), "label", F.explode("p").alias("node"))
    work = inside.union(members).union(pivots).distinct().withColumn("tied", F.col("node")).withColumn("asked", F.lit(False))
    return _ties(scratch, scratch.write(work, "work"), texts, "first-ties", width, percent)


def _open_ties(
    scratch: Scratch, sized: DataFrame, label: DataFrame, named: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame | None:
    """Links of big groups' sets outside their largest component with the others; None if there are none.

    They meet in a grid of blocks.  In groups so large that a text would go to many blocks, bitmaps of
    the sets meet first, and texts only where these leave room for a link.
    """
    tied = sized.filter("big").join(label.select("node", F.col("label").alias("tied")), "node", "left")
    tied = scratch.write(tied.withColumn("tied", F.coalesce("tied", "node")), "tied")
    counts = tied.groupBy("label", "tied").agg(F.count("*").alias("m"), F.sum("chars").alias("chars"))
    main = counts.groupBy("label").agg(
        F.max_by("tied", F.struct("m", "tied")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("m"), (F.sum("chars") / F.sum("m")).alias("mean")
    )
    # A task takes as many sets of either side as their texts allow: the larger, the fewer tasks each set goes to.
    block = F.greatest(F.lit(1.0), F.least(F.lit(OPEN_BLOCKS * BLOCK), F.floor(TASK_CHARS / F.greatest("mean", F.lit(1.0)))))
    main = main.filter("m < n").select("label", "main", "n", "m", F.ceil((F.col("n") - F.col("m")) / block).alias("few"), F.ceil(F.col("n") / block).alias("all"))
    rows = scratch.write(tied.select("label", "node", "tied", "chars").join(main, "label").withColumn("asked", F.col("tied") != F.col("main")), "open")
    if rows.isEmpty():
        return None
    grid = (F.col("n") - F.col("m")) * F.col("all") + F.col("n") * F.col("few")
    wide = main.select("label", "n", grid.alias("grid"), ((F.col("n") - F.col("m")) * F.col("n")).alias("meetings"))
    wide = scratch.write(wide.filter(F.col("grid") > WIDE * F.col("n")), "wide")
    if wide.isEmpty():
        return _ties(scratch, _grid(rows), texts, "open-ties", width, percent)
    pairs = _candidates(scratch, rows, wide, named, texts, width, percent)
    # Where most sets of a group may link, their pairs are more than its grid's rows.
    few = wide.join(pairs.groupBy("label").agg(F.count("*").alias("pairs")), "label", "left").filter("coalesce(pairs, 0) <= grid").select("label")
    few = scratch.write(few, "open-ways")
    work = _beside(scratch, rows, pairs.join(few, "label")).union(_grid(rows.join(few, "label", "left_anti")))
    return _ties(scratch, work, texts, "open-ties", width, percent)


def _candidates(scratch: Scratch, rows: DataFrame, wide: DataFrame, named: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (label, asker, asker_tied, node, tied) of wide groups whose bitmaps leave room for a link, each once.

    Bitmaps meet at tiles that asking sets share with others, or, where tiles have more pairs than the
    group itself, by group; either in blocks, so that a tile that very many sets share is in many tasks.
    """
    mine = rows.join(wide.select("label"), "label").select("label", "node", "tied", "asked")
    met = scratch.write(named.select("tile", "node").distinct().join(mine, "node"), "open-tiles")
    here = (F.count("*").alias("here"), F.sum(F.col("asked").cast("long")).alias("askers"), F.min("tied").alias("low"), F.max("tied").alias("high"))
    shared = scratch.write(met.groupBy("tile", "label").agg(*here).filter("askers > 0 AND low <> high").drop("low", "high"), "open-shared")
    pairs = shared.groupBy("label").agg(F.sum(F.col("here") * F.col("askers")).alias("pairs"))
    by_tile = scratch.write(wide.join(pairs, "label", "left").filter("coalesce(pairs, 0) <= meetings").select("label"), "open-tiled")
    at_tiles = met.join(shared.join(by_tile, "label").drop("label"), "tile").withColumn("place", F.xxhash64("tile", F.lit(1)))
    whole = mine.join(by_tile, "label", "left_anti")
    at_groups = whole.join(whole.groupBy("label").agg(*here[:2]), "label").withColumn("place", F.xxhash64("label", F.lit(2)))
    columns = ["place", "label", "node", "tied", "asked", "here", "askers"]
    side = SKETCH_BLOCKS * BLOCK
    places = at_tiles.select(*columns).union(at_groups.select(*columns)).withColumns({"few": F.ceil(F.col("askers") / side), "all": F.ceil(F.col("here") / side)})
    places = scratch.write(places.drop("here", "askers"), "open-places")
    small = F.lit(max(1, places.filter("few * all = 1").count() // side))

    def block(frame: DataFrame, role: bool, x: Column, y: Column) -> DataFrame:
        dealt = frame.select("place", "label", "node", "tied", F.col("asked").alias("asks"), F.lit(role).alias("asked"), "few", "all", x.alias("x"), y.alias("y"))
        task = F.when(F.col("few") * F.col("all") == 1, _piece(F.col("place"), small, 7)).otherwise(F.xxhash64("place", "x", "y"))
        return dealt.select(task.alias("task"), "place", "x", "y", "label", "node", "tied", "asks", "asked")

    asking = block(places.filter("asked"), True, _piece(F.col("node"), F.col("few"), 8), F.explode(F.expr("sequence(0L, all - 1)")))
    others = block(places, False, F.explode(F.expr("sequence(0L, few - 1)")), _piece(F.col("node"), F.col("all"), 9))
    bits = scratch.write(_sketched(texts.join(mine.select("node"), "node"), width).dropDuplicates(["node"]), "open-sketches")
    full = asking.union(others).join(bits, "node")
    found = full.groupBy("task").applyInPandas(_meet(percent), "label long, asker long, asker_tied long, node long, tied long")
    return scratch.write(found.distinct(), "open-pairs")


def _sketched(texts: DataFrame, width: int) -> DataFrame:
    """``node``, number of shingles and bitmap of each set; another text of the set's id is left out."""
    spark_schema, schema = arrow_schema("node long, n_shingles long, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                nodes, digests, texts = (c.to_pylist() for c in whole.slice(at, 500).columns)
                out = [(node, len(s), sketch(s)) for node, h1, s in zip(nodes, digests, (shingles(t, width) for t in texts), strict=True) if _digest(s)[0] == h1]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return texts.select("node", "h1", "text").mapInArrow(run, spark_schema)


def _meet(percent: int):
    """Pairs of an asking set and another of the same block whose bitmaps leave room for a link; of two that both ask, from the lesser only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "x", "y"], ignore_index=True)
        where = rows[["place", "x", "y"]].to_numpy()
        ends = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, len(rows)]
        label, node, tied, n = (rows[c].to_numpy() for c in ("label", "node", "tied", "n_shingles"))
        asks, asked, bits, out = rows.asks.to_numpy(), rows.asked.to_numpy(), rows.bits.to_numpy(), [np.empty((5, 0), np.int64)]
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            left, right = start + np.flatnonzero(asked[start:end]), start + np.flatnonzero(~asked[start:end])
            if not len(left) or not len(right):
                continue
            for a, b in sketches_may_link(list(bits[left]), n[left], list(bits[right]), n[right], percent):
                a, b = left[a], right[b]
                new = (tied[a] != tied[b]) & (~asks[b] | (node[a] < node[b]))
                a, b = a[new], b[new]
                out.append(np.stack([label[a], node[a], tied[a], node[b], tied[b]]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["label", "asker", "asker_tied", "node", "tied"]).drop_duplicates()

    return run


def _beside(scratch: Scratch, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Work in which each asking set meets the sets it has pairs with; one that has very many is in several tasks."""
    sized = pairs.join(rows.select("node", "chars"), "node")
    of = sized.groupBy("asker").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / TASK_CHARS)).alias("pieces"))
    pairs = scratch.write(sized.join(of, "asker"), "open-beside")
    total = pairs.agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).first()
    tasks = max(1, total["n"] // SMALL_PER_TASK, (total["chars"] or 0) // TASK_CHARS)
    task = F.when(F.col("pieces") > 1, F.xxhash64("asker", _piece(F.col("node"), F.col("pieces"), 6))).otherwise(_piece(F.col("asker"), F.lit(tasks), 5)).alias("task")
    others = pairs.select(task, F.col("asker").alias("label"), "node", "tied", F.lit(False).alias("asked"))
    own = pairs.select(task, F.col("asker").alias("label"), F.col("asker").alias("node"), F.col("asker_tied").alias("tied"), F.lit(True).alias("asked")).distinct()
    return others.union(own)


def _grid(rows: DataFrame) -> DataFrame:
    """Work in which every asking set meets every set of its group, block by block."""
    asked = rows.filter("asked").select(
        "label", "node", "tied", _piece(F.col("node"), F.col("few"), 8).alias("x"), F.explode(F.expr("sequence(0L, all - 1)")).alias("y"), F.lit(True).alias("asked")
    )
    others = rows.select(
        "label", "node", "tied", F.explode(F.expr("sequence(0L, few - 1)")).alias("x"), _piece(F.col("node"), F.col("all"), 9).alias("y"), F.lit(False).alias("asked")
    )
    return asked.union(others).select(F.xxhash64("label", "x", "y").alias("task"), "label", "node", "tied", "asked")


def keep_one(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row of each component and each row without words, all columns as they are.

    The row of the smallest id stays, a row without id only where none has one.  Of rows that repeat
    an id and a set of shingles, or an id and a text without words, one is kept.
    """
    rows, classes = _linked(frame, id_col, text_col, width, percent)
    joined = rows.join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    gone = joined.filter("component < id").select(F.col("id").alias("__gone")).distinct()
    # Only rows without an id of their own meet by text; the others are not shuffled for it.
    again = rows.groupBy(F.col("id").alias("__again")).agg(F.count("*").alias("n")).filter("n > 1 OR __again IS NULL").select("__again")
    again = Scratch(frame.sparkSession).write(again, "again")
    ident = F.col(id_col).cast("long")
    kept = frame.join(gone, ident == F.col("__gone"), "left_anti")
    if again.isEmpty():
        return kept
    kept = kept.filter(F.col(id_col).isNotNull()).join(again, ident == F.col("__again"), "left_anti")

    def digests(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, width) for t in texts]
        return pd.DataFrame([(*_digest(s), len(s)) for s in sets], columns=["h1", "h2", "n"], dtype="int64")

    of = F.pandas_udf(digests, "h1 long, h2 long, n long")(F.col(text_col))
    shared = frame.join(again, ident.eqNullSafe(F.col("__again")), "left_semi").withColumn("__set", of)
    bare = shared.filter("__set.n = 0").dropDuplicates([id_col, text_col])
    winner = classes.select("winner.first", "c1", "c2").filter("winner.h1 = c1 AND winner.h2 = c2")
    first = (F.col("__set.h1") == F.col("c1")) & (F.col("__set.h2") == F.col("c2")) & ident.eqNullSafe(F.col("first"))
    winners = shared.filter("__set.n > 0").join(winner, first, "left_semi").dropDuplicates([id_col, "__set"])
    return kept.unionByName(bare.unionByName(winners).drop("__set"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))
