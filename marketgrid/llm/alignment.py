"""Alignment of two tokenisations of the same texts (operator 13).

The ends of both tokenizers' tokens, as byte offsets, are two sorted lists.  Merge-path partitioning
cuts their merging into pieces of equal work: the point where the merge crosses each diagonal is found
by binary search, so every piece knows its part of either list and needs nothing of the others.  A
piece emits the overlaps of its ends; where an end of both lists falls on a seam, the overlap that both
pieces see is dropped, and groups that run over a seam are stitched by their number of common ends.
The lists of many documents lie end to end, so long documents and short ones make pieces alike.

How often two ids are linked in the corpus is counted by chunks: rows of documents whose links number
some millions share a dictionary of their pairs, only the dictionaries meet by pair, and each
chunk's dictionary comes back with the counts to the chunk's rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import kind
from .common import Scratch, arrow_schema, read, vocabulary_path

#: Vocabularies: ranks of the byte-level one, model of the piece one.
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Ends that a piece of the merge takes.
WORK = 1 << 16
#: Links and rows after which a chunk is closed, and characters that are tokenised at a time.
CHUNK_LINKS, CHUNK_ROWS, BATCH_CHARS = 4_000_000, 20_000, 400_000


@dataclass(frozen=True)
class Pair:
    """Both tokenizers of a worker: encoders, bytes of their tokens, and their ids as text."""

    encode_a: object
    encode_b: object
    size_a: np.ndarray
    size_b: np.ndarray
    bytes_b: list[bytes]
    written: list[str]


@lru_cache(maxsize=2)
def tokenizers(ranks: str, pieces: str) -> Pair:
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    size_a = np.zeros(max(known.values()) + 1, np.int64)
    for token, rank in known.items():
        size_a[rank] = len(token)
    bytes_b = [
        bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()
        for k, p in enumerate(model.id_to_piece(k) for k in range(model.get_piece_size()))
    ]
    ends = [f"{k}{mark}" for k in range(len(size_a)) for mark in ",|"] + [f"{k}{mark}" for k in range(len(bytes_b)) for mark in ",;"]
    return Pair(plain.encode_ordinary, model.encode, size_a, np.array(list(map(len, bytes_b))), bytes_b, ends)


def crossings(x: np.ndarray, y: np.ndarray, work: int = WORK) -> list[tuple[int, int, int, int]]:
    """Merge-path pieces (from and to in ``x``, from and to in ``y``) of ``work`` ends each; ends of ``x`` go before equal ones of ``y``."""
    total = len(x) + len(y)
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(diagonal - len(y), 0), np.minimum(diagonal, len(x))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        before = x[middle] <= y[diagonal[open_] - 1 - middle]
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)
    cuts = list(zip(low.tolist(), (diagonal - low).tolist(), strict=True))
    return [(a0, a1, b0, b1) for (a0, b0), (a1, b1) in zip(cuts, cuts[1:], strict=False)]


def overlaps(x: np.ndarray, y: np.ndarray, piece: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a piece as places in ``x`` and ``y``, by end, and the ends that both lists have."""
    a0, a1, b0, b1 = piece
    of_x, of_y = x[a0:a1], y[b0:b1]
    in_y = b0 + np.searchsorted(of_y, of_x)
    in_x = a0 + np.searchsorted(of_x, of_y)
    # Seam: an end of x that closed the piece before meets its equal, the first end of y, here.
    seam = a0 > 0 and len(of_y) and x[a0 - 1] == of_y[0]
    inside = in_x < len(x)
    same = np.zeros(len(of_y), bool)
    same[inside] = x[in_x[inside]] == of_y[inside]
    same &= in_x < a1
    if seam:
        same[0] = True
    own = ~same
    links_a = np.concatenate([np.arange(a0, a1), in_x[own]])
    links_b = np.concatenate([in_y, np.arange(b0, b1)[own]])
    order = np.argsort(np.concatenate([of_x, of_y[own]]), kind="stable")
    return links_a[order], links_b[order], of_y[same]


@dataclass
class Aligned:
    """Alignment of a batch of texts laid end to end; ``rows`` are the texts that have tokens."""

    rows: list[int]
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray  # tokens before each text, and all
    cut_b: np.ndarray
    link_a: np.ndarray  # places in a and b
    link_b: np.ndarray
    cut_links: np.ndarray
    group_a: np.ndarray  # tokens up to and with each group
    group_b: np.ndarray
    cut_groups: np.ndarray


def align_texts(texts: list[str | None], pair: Pair, work: int = WORK) -> Aligned:
    """Tokens, links and groups of texts; null and empty ones and those that a tokenizer doesn't give back have none."""
    rows, all_a, all_b, ends = [], [], [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        whole, b = f" {text}", pair.encode_b(text)
        a, raw = np.array(pair.encode_a(whole), np.int64), whole.encode()
        if int(pair.size_a[a].sum()) == len(raw) and b"".join(map(pair.bytes_b.__getitem__, b)) == raw:
            rows.append(k)
            all_a.append(a)
            all_b.append(np.array(b, np.int64))
            ends.append(len(raw))
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *all_a]), np.concatenate([none, *all_b])
    x, y = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    stops = np.cumsum([0, *ends])
    parts = [overlaps(x, y, piece) for piece in crossings(x, y, work)] if rows else []
    link_a, link_b, common = (np.concatenate([none, *(p[k] for p in parts)]) for k in range(3))
    group_a, group_b = np.searchsorted(x, common, "right"), np.searchsorted(y, common, "right")
    cut_a, cut_b = np.searchsorted(x, stops, "right"), np.searchsorted(y, stops, "right")
    return Aligned(rows, a, b, cut_a, cut_b, link_a, link_b, np.searchsorted(link_a, cut_a), group_a, group_b, np.searchsorted(common, stops, "right"))


def written_groups(found: Aligned, pair: Pair) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    before_a, before_b = np.append(0, found.group_a), np.append(0, found.group_b)
    at_a, at_b = np.arange(len(found.a)), np.arange(len(found.b))
    of_a, of_b = np.searchsorted(found.group_a, at_a, "right"), np.searchsorted(found.group_b, at_b, "right")
    last_a, last_b = np.zeros(len(at_a), np.int64), np.zeros(len(at_b), np.int64)
    last_a[found.group_a - 1] = 1
    last_b[found.group_b - 1] = 1
    signs = np.empty(len(at_a) + len(at_b), np.int64)
    signs[at_a + before_b[of_a]] = 2 * found.a + last_a
    signs[at_b + before_a[of_b + 1]] = 2 * len(pair.size_a) + 2 * found.b + last_b
    look, cuts = pair.written.__getitem__, (found.cut_a + found.cut_b).tolist()
    return ["".join(map(look, signs[p:q].tolist()))[:-1] for p, q in zip(cuts, cuts[1:], strict=False)]


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of some characters each, so that the merge's lists stay small."""
    sums = [0, *accumulate(len(t or "") + 50 for t in texts)]
    start = 0
    for k in range(1, len(sums)):
        if sums[k] - sums[start] >= BATCH_CHARS or k == len(texts):
            yield start, k
            start = k


def _paths(ranks: str | None, pieces: str | None) -> tuple[str, str]:
    return ranks or vocabulary_path(RANKS), pieces or vocabulary_path(PIECES)


def align(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """``id_col``, token ids ``a`` and ``b``, tokens up to and with each group (``group_a``, ``group_b``) and links (``link_a``, ``link_b``, places in the text's tokens).

    One pass, no shuffle.  Rows repeated stay; null and empty texts have empty arrays.
    """
    paths = _paths(ranks, pieces)
    names = ("a", "b", "group_a", "group_b", "link_a", "link_b")
    spark_schema, schema = arrow_schema(f"{id_col} {kind(frame, id_col)}, " + ", ".join(f"{n} array<int>" for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*paths)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _portions(texts):
                found = align_texts(texts[start:stop], pair)
                out = {n: [[]] * (stop - start) for n in names}
                for k, row in enumerate(found.rows):
                    a, b, links, groups = (slice(*cut[k : k + 2]) for cut in (found.cut_a, found.cut_b, found.cut_links, found.cut_groups))
                    values = (found.a[a], found.b[b], found.group_a[groups] - a.start, found.group_b[groups] - b.start, found.link_a[links] - a.start, found.link_b[links] - b.start)
                    for n, value in zip(names, values, strict=True):
                        out[n][row] = value.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *(pa.array(out[n], schema.field(n).type) for n in names)], schema=schema)

    return frame.select(id_col, text_col).mapInArrow(run, spark_schema)


class _Chunk:
    """Rows of some documents until their links fill a chunk."""

    def __init__(self, name: int) -> None:
        self.name, self.rows, self.links, self.codes, self.times = name, [], 0, [], []

    def add(self, row: tuple, codes: np.ndarray, times: np.ndarray, links: int) -> None:
        self.rows.append(row)
        self.codes.append(codes)
        self.times.append(times)
        self.links += links

    def full(self) -> bool:
        return self.links >= CHUNK_LINKS or len(self.rows) >= CHUNK_ROWS

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([np.empty(0, np.int64), *self.codes])
        pairs, places = np.unique(every, return_inverse=True)
        counts = np.bincount(places, np.concatenate([np.empty(0), *self.times]), len(pairs)).astype(np.int64)
        stops = np.cumsum([0, *map(len, self.codes)])
        for at in range(0, len(self.rows), 500):
            part = range(at, min(at + 500, len(self.rows)))
            columns = list(zip(*(self.rows[k] for k in part), strict=True))
            arrays = [[places[stops[k] : stops[k + 1]].astype(np.int32) for k in part], [self.times[k].astype(np.int32) for k in part]]
            empty = [None] * len(part)
            yield self._batch(schema, [[self.name] * len(part), *columns, *arrays, empty, empty])
        if len(pairs):
            yield self._batch(schema, [[self.name], *([[None]] * (len(schema) - 3)), [pairs], [counts]])

    @staticmethod
    def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SUMS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _made(frame: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """A row for each document, its pairs as places in the chunk's dictionary, and a row with the dictionary for each chunk."""
    spark_schema, schema = arrow_schema(f"chunk long, {id_col} {kind(frame, id_col)}, {_SUMS}, places array<int>, times array<int>, pairs array<long>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, name = tokenizers(*paths), TaskContext.get().partitionId() << 32
        width, chunk = len(pair.size_b), _Chunk(name)
        none = np.empty(0, np.int64)
        for batch in batches:
            idents, texts = (c.to_pylist() for c in batch.columns)
            for start, stop in _portions(texts):
                found = align_texts(texts[start:stop], pair)
                codes = found.a[found.link_a] * width + found.b[found.link_b]
                sums = (np.diff(c).tolist() for c in (found.cut_a, found.cut_b, found.cut_groups, found.cut_links))
                digests = (hashlib.sha256(w.encode()).hexdigest() for w in written_groups(found, pair))
                by_row = dict(zip(found.rows, zip(*sums, digests, strict=True), strict=True))
                cuts = dict(zip(found.rows, zip(found.cut_links, found.cut_links[1:], strict=False), strict=True))
                for k in range(stop - start):
                    own, times = np.unique(codes[slice(*cuts[k])], return_counts=True) if k in cuts else (none, none)
                    n_a, n_b, groups, links, digest = by_row.get(k, (0, 0, 0, 0, ""))
                    chunk.add((idents[start + k], n_a, n_b, groups, links, digest), own, times, links)
                    if chunk.full():
                        yield from chunk.batches(schema)
                        name += 1
                        chunk = _Chunk(name)
        yield from chunk.batches(schema)

    return frame.select(id_col, text_col).mapInArrow(run, spark_schema)


def _scored(out: pa.Schema):
    """Rows of a chunk and its dictionary's counts -> the rows with their sums."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), np.int64)
        at = answers.column("place").to_numpy()
        count[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
        sums = []
        for places, times in zip(rows.column("places").combine_chunks(), rows.column("times").combine_chunks(), strict=True):
            where, often = places.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            sums.append((int(often @ best[where]), int(often @ count[where])))
        n_best, total = zip(*sums, strict=True) if sums else ((), ())
        given = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.Table.from_arrays([given.get(f.name, rows.column(f.name) if f.name in rows.column_names else None) for f in out], schema=out)

    return run


def link_counts(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row for each document: its tokens, groups and links, and how its links fare in the whole corpus.

    ``n_best`` are the links whose ids are linked most often among those of their B id (ties included),
    ``count_sum`` adds up their pairs' counts.  A document's links are kept as places in its chunk's
    dictionary; a pair, however common, has one row for each chunk.  Null, empty and not restorable
    texts have zeros and the empty string, repeated rows count one by one, an empty table gives none.
    """
    scratch, paths = Scratch(frame.sparkSession), _paths(ranks, pieces)
    width = len(tokenizers(*paths).size_b)
    made = scratch.write(_made(frame, id_col, text_col, paths), "made")
    asked = made.filter("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "entry"))
    asked = asked.select("chunk", "place", F.col("entry.pairs").alias("pair"), F.col("entry.counts").alias("times"))
    counts = scratch.write(asked.groupBy("pair").agg(F.sum("times").alias("n")), "counts")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    known = counts.join(F.broadcast(highest), F.col("pair") % width == F.col("b"))  # a row for each B id at most
    known = known.select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    answers = asked.select("chunk", "place", "pair").join(known, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    rows = made.filter("pairs IS NULL").drop("pairs", "counts")
    spark_schema, schema = arrow_schema(f"{id_col} {kind(frame, id_col)}, {_SUMS}, n_best long, count_sum long")
    return rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_scored(schema), spark_schema)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(read(spark, sf_dir, "documents"))
