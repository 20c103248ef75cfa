"""Merkle manifest of a table: one digest for all rows, and for each row the proof that it is among them (operator 11).

Time-forward processing.  Every node of the tree has a label that is larger than its children's, and a
node's digest travels as a message to its parent's label.  The external priority queue of these
messages is a table sorted by label, drained in rounds: a round reads the messages of whole blocks of
``FAN ** DEPTH`` consecutive nodes, each task runs through its blocks in label order with a queue of a
few dozen messages, and what leaves a block is a message to the block above.  The reversed sweep goes
from the root to the leaves: each block hands its children the part of the proof that they share.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, read

#: Children of a node, and levels of the tree that one task climbs in one block.
FAN, DEPTH = 16, 3
BLOCK = FAN**DEPTH
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<before: string, after: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    def part(x: Column) -> Column:
        text = x.cast("string")
        return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, fields)), 256)


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(total: int) -> int:
    """Levels that one round adds above a group of ``total`` nodes."""
    levels = 0
    while levels < DEPTH and FAN**levels < total:
        levels += 1
    return levels


def climb(digests: Iterator[str], levels: int) -> str:
    """The digest of a block of consecutive nodes, ``levels`` further up.

    A node's label is (last place below it, level); messages leave the queue as soon as no place
    that they wait for is to come, so it holds at most ``FAN`` of them for each level.
    """
    queue: list[tuple[int, int, int, str]] = []

    def send(place: int, level: int, digest: str) -> None:
        span = FAN ** (level + 1)
        heapq.heappush(queue, (place // span * span + span - 1, level + 1, place, digest))

    def drain(before: int) -> str:
        digest = ""
        while queue and queue[0][0] < before:
            end, level, place, digest = heapq.heappop(queue)
            run = [digest]
            while queue and queue[0][:2] == (end, level):
                run.append(heapq.heappop(queue)[3])
            digest = _h(run)
            if level < levels:
                send(place, level, digest)
        return digest

    for place, digest in enumerate(digests):
        if not levels:
            return digest
        drain(place)
        send(place, 0, digest)
    return drain(BLOCK * FAN)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, total, pos, digest) sorted by block and place -> one such row for each block."""
    held: list[pa.RecordBatch] = []

    def close() -> tuple:
        first = held[0].slice(0, 1).to_pylist()[0]
        whole = (d for b in held for d in b.column(3).to_pylist())
        return first["grp"], -(-first["total"] // BLOCK), first["pos"] // BLOCK, climb(whole, _levels(first["total"]))

    for batch in batches:
        at, out = 0, []
        for start in np.flatnonzero(batch.column(2).to_numpy() % BLOCK == 0):
            held.append(batch.slice(at, start - at))
            held[:] = [b for b in held if b.num_rows]
            if held:
                out.append(close())
            held.clear()
            at = start
        held.append(batch.slice(at))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), batch.schema, strict=True)], schema=batch.schema)
    held[:] = [b for b in held if b.num_rows]
    if held:
        schema = held[0].schema
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(close(), schema, strict=True)], schema=schema)


def siblings(digests: list[str], levels: int, above: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """For each node of a block what stands before and after it, level by level up to the root, which ``above`` closes."""
    layers = [digests]
    for _ in range(levels - 1):
        layers.append([_h(layers[-1][k : k + FAN]) for k in range(0, len(layers[-1]), FAN)])
    paths = [above]  # of the block's own node
    for layer in reversed(layers[1:] if levels else []):
        paths = [[_around(layer, k), *paths[k // FAN]] for k in range(len(layer))]
    for k in range(len(digests)):
        yield [_around(digests, k), *paths[k // FAN]] if levels else above


def _around(layer: list[str], k: int) -> tuple[str, str]:
    first = k - k % FAN
    return "".join(layer[first:k]), "".join(layer[k + 1 : first + FAN])


def _down(schema: pa.Schema, rows: int = 500):
    """Blocks, each a message row (pos = -1, with proof) and its nodes -> the nodes with their proofs."""

    def give(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([b for b in held if b.num_rows]).combine_chunks()
        above = [(p["before"], p["after"]) for p in whole.column("proof")[0].as_py()]
        nodes = whole.slice(1)
        levels = _levels(nodes.column("total")[0].as_py())
        paths = siblings(nodes.column("digest").to_pylist(), levels, above)
        for at in range(0, nodes.num_rows, rows):
            part = nodes.slice(at, rows).combine_chunks().to_batches()[0]
            offsets, before, after = [0], [], []
            for _, path in zip(range(part.num_rows), paths, strict=False):
                before += [b for b, _ in path]
                after += [a for _, a in path]
                offsets.append(len(before))
            proof = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(schema.field("proof").type.value_type)),
                type=schema.field("proof").type,
            )
            same = {n: pa.array([whole.column(n)[0].as_py()] * part.num_rows, pa.string()) for n in ("subroot", "root")}
            yield pa.RecordBatch.from_arrays([proof if n == "proof" else same.get(n, part.column(n) if n in part.schema.names else None) for n in schema.names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            for start in np.flatnonzero(batch.column(batch.schema.names.index("pos")).to_numpy() == -1):
                held.append(batch.slice(at, start - at))
                if any(b.num_rows for b in held):
                    yield from give(held)
                held, at = [], start
            held.append(batch.slice(at))
        if any(b.num_rows for b in held):
            yield from give(held)

    return run


def _placed(scratch: Scratch, nodes: DataFrame, name: str) -> DataFrame:
    """``pos``, the place of each node in its group by (key, digest), and ``total``, its group's nodes.

    One range sort over all groups; places within a task plus the counts of the tasks before, so a
    group may be as large as the table.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest").asc()]
    ranged = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = scratch.write(ranged.withColumn("task", F.shiftright("at", 33)), name)
    counts = ranged.groupBy("grp", "task").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    of = Window.partitionBy("grp")
    earlier = F.coalesce(F.sum("n").over(of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(
        F.col("grp").alias("g"), F.col("task").alias("t"), (F.col("start") - earlier).alias("start"), F.sum("n").over(of).alias("total")
    )
    joined = ranged.join(starts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("task") == F.col("t")))
    return scratch.write(joined.withColumn("pos", F.col("at") - F.col("start")).drop("g", "t", "at", "task", "start"), f"{name}-placed")


def _sorted(rows: DataFrame) -> DataFrame:
    """Blocks whole, in label order; every block has at most ``BLOCK`` rows and a message."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _rise(scratch: Scratch, nodes: DataFrame, name: str) -> list[DataFrame]:
    """Rows (grp, total, pos, digest) of each round, from the given nodes up to groups of one node."""
    rounds = [nodes.select("grp", "total", "pos", "digest")]
    while True:
        open_ = rounds[-1].filter("total > 1")
        if open_.isEmpty():
            return rounds
        blocks = _sorted(open_.withColumn("block", F.expr(f"pos div {BLOCK}"))).drop("block")
        rounds.append(scratch.write(blocks.mapInArrow(_up, rounds[-1].schema), f"{name}-round-{len(rounds)}"))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0].filter("total = 1")
    for r in rounds[1:]:
        out = out.unionByName(r.filter("total = 1"))
    return out.select("grp", "digest")


def _sink(scratch: Scratch, rounds: list[DataFrame], nodes: DataFrame, tops: DataFrame, name: str) -> DataFrame:
    """``nodes`` (the first round's rows with further columns) with proof, subroot and root; ``tops`` has these of each group's root."""
    def single(level: DataFrame) -> DataFrame:
        top = tops.withColumnRenamed("grp", "g")
        return level.filter("total = 1").join(top, F.col("grp").eqNullSafe(F.col("g"))).drop("g")

    messages = None
    for r in range(len(rounds) - 1, -1, -1):
        level = nodes if r == 0 else rounds[r]
        below = single(level)
        if messages is not None:
            asked = level.filter("total > 1").withColumn("block", F.expr(f"pos div {BLOCK}"))
            both = _sorted(asked.unionByName(messages.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "proof", "subroot", "root"), allowMissingColumns=True))
            out = T.StructType([*level.schema.fields, *T._parse_datatype_string(f"proof {_PROOF}, subroot string, root string").fields])
            given = both.mapInArrow(_down(to_arrow_schema(out)), out)
            below = below.select(*out.names).unionByName(given)
        if r == 0:
            return below
        messages = scratch.write(below.select("grp", "pos", "proof", "subroot", "root"), f"{name}-messages-{r}")
    raise AssertionError


def manifest(frame: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf") -> DataFrame:
    """All columns of ``frame`` plus ``subroot``, ``root`` and ``proof`` of each row.

    ``leaf`` holds the rows' digests.  In each group the leaves ascend by ``key`` (nulls first, rows
    of one key by leaf), every 16 consecutive nodes become one; groups, null first, meet in the root
    likewise.  ``proof`` has for each level, leaves first, the joined digests before and after the
    node in its run; :func:`fold` climbs it.  Rows repeated stay apart as leaves of their own; a
    group may hold any share of the rows; an empty table gives no rows.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark)
    inner = frame.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("digest"), F.struct(*(F.col(c) for c in frame.columns)).alias("carry"))
    leaves = _placed(scratch, scratch.write(inner, "digests"), "leaves").drop("key")
    rounds = _rise(scratch, leaves, "groups")
    subroots = scratch.write(_roots(rounds), "subroots")
    tops = _placed(scratch, subroots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), "digest"), "tops")
    above = _rise(scratch, tops, "tops")
    root = _roots(above).select("grp", F.array().cast(_PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_group = _sink(scratch, above, tops, scratch.write(root, "root"), "tops").select(F.col("key").alias("grp"), "proof", F.col("digest").alias("subroot"), "root")
    out = _sink(scratch, rounds, leaves, scratch.write(of_group, "of-group"), "groups")
    return out.select("carry.*", "subroot", "root", "proof")


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf and its proof lead to."""
    leaf, proof = (F.col(x) if isinstance(x, str) else x for x in (leaf, proof))
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    leaf = leaf_digest(*(F.col(f) for f in FIELDS))
    tampered = leaf_digest(*(F.translate(f, _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(hit, tampered).alias("tampered"))
    made = manifest(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), "proof"))
    siblings_ = F.concat_ws("", F.transform("proof", lambda p: F.concat(p["before"], p["after"])))
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings_, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The same tree level by level, siblings by windows over runs; CRC-32 bit by bit.
OP11_SQL = """
WITH RECURSIVE RAW AS (
  SELECT doc_id, source, lang, n_chars, text FROM documents),
bits AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(256 + ascii(c) AS BIGINT), 512, 512, 512, 512, 512, 512, 512, 512]))),
    lambda a, x: CASE WHEN x = 512 THEN CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END
                      ELSE xor(a, x - 256) END) AS reg
  FROM (SELECT DISTINCT doc_id FROM RAW WHERE doc_id IS NOT NULL)),
leaves AS (
  SELECT r.doc_id, source, coalesce(xor(reg, 4294967295) % 5 = 0, false) AS hit,
    sha256(concat(
      coalesce(concat(strlen(CAST(r.doc_id AS VARCHAR)), ':', r.doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-'),
      coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(
      coalesce(concat(strlen(CAST(r.doc_id AS VARCHAR)), ':', r.doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-'),
      coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-'))) AS changed
  FROM RAW r LEFT JOIN bits b ON r.doc_id = b.doc_id),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
up AS (
  SELECT 0 AS lvl, source, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lvl + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY lvl, source, pos // 16, n),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1
  GROUP BY lvl, pos // 16, n),
around AS (
  SELECT lvl, source, pos,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY lvl, source, pos // 16 ORDER BY pos)),
above AS (
  SELECT lvl, pos,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 16 ORDER BY pos)),
steps AS (
  SELECT rid, a.lvl, a.before, a.after FROM placed p JOIN around a
    ON p.source IS NOT DISTINCT FROM a.source AND a.pos = CAST(p.pos AS BIGINT) >> (4 * a.lvl)
  UNION ALL
  SELECT rid, 100 + a.lvl, a.before, a.after FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
    JOIN above a ON a.pos = CAST(s.pos AS BIGINT) >> (4 * a.lvl)),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY lvl) AS siblings, list({'b': before, 'a': after} ORDER BY lvl) AS path FROM steps GROUP BY rid),
roots AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (
  SELECT p.doc_id, leaf, subroot, root, siblings,
    list_reduce(list_prepend({'b': CASE WHEN hit THEN changed ELSE leaf END, 'a': ''}, coalesce(path, [])),
                lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b AS folded
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN roots LEFT JOIN proofs USING (rid))
"""
