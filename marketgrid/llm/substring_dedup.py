"""Substring dedup by hashing lines and their sentences (operator 2)."""

from __future__ import annotations

import re
import zlib

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import kind
from .common import Scratch, flat_map_rows, map_rows, read

#: A stretch of repeated units goes if it has so many words; shorter coincidences stay.
MIN_WORDS = 10
#: A repeated unit that is a whole line goes from so many words on.
MIN_LINE_WORDS = 5
#: Sentences of so many words are cut further, into pieces of at least so many; a cut is the least hash so near.
LONG_WORDS, PIECE_WORDS, NEAR = 16, 5, 4
_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_SIGN = 1 << 63
REPEATED = "__repeated"


def _pieces(line: str):
    """(start, end) of a line's sentences; long ones are cut after words whose hash is the least near them.

    Whether a word ends a piece depends on the ``NEAR`` words on either side alone, so cuts fall alike
    in every copy, also where a passage stands inside a sentence of its own or a copy was edited.
    """
    at = 0
    for sentence in _SENTENCE.split(line):
        if sentence.count(" ") < LONG_WORDS:
            yield at, at + len(sentence)
        else:
            start, k = at, NEAR
            words = list(_WORD.finditer(sentence))
            last = [zlib.crc32(w[0].lower().encode()) for w in words]
            # With the word before, or frequent words would tie.
            hashes = [(x * 2654435761 + y * 40503) & 0xFFFFFFFF for x, y in zip([0, *last], last, strict=False)]
            while k < len(words) - NEAR:
                x = hashes[k]
                if x < hashes[k - 1] and x <= hashes[k + 1] and x < min(hashes[k - NEAR : k]) and x <= min(hashes[k + 1 : k + NEAR + 1]):
                    yield start, at + words[k].end()
                    start = at + words[k].end()
                    k += NEAR
                k += 1
            if start < at + len(sentence):
                yield start, at + len(sentence)
        at += len(sentence) + 1


def units(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, normalised text, is a whole line) of each non-blank piece of each line, in order.

    Normalised: lower case, white space runs as one blank.
    """
    out, at = [], 0
    for line in text.split("\n"):
        for start, end in _pieces(line):
            normal = " ".join(line[start:end].split()).lower()
            if normal:
                out.append((at + start, at + end, normal, end - start == len(line)))
        at += len(line) + 1
    return out


def _digest(normal: str) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(normal.encode())
    return (value >> 64) - _SIGN, (value & (2 * _SIGN - 1)) - _SIGN


def windows(found: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """(first, behind the last, text) of each least stretch of ``MIN_WORDS`` words in units too short to tell by themselves."""
    out, behind, words = [], 0, 0
    sizes = [u[2].count(" ") + 1 for u in found]
    for first in range(len(found)):
        if behind < first:
            behind, words = first, 0
        while behind < len(found) and words < MIN_WORDS and sizes[behind] < PIECE_WORDS:
            words += sizes[behind]
            behind += 1
        if words >= MIN_WORDS:
            out.append((first, behind, " ".join(u[2] for u in found[first:behind])))
        if behind > first:
            words -= sizes[first]
    return out


def _cut(text: str, repeated: set[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """Remove stretches of units that are in ``repeated`` or stood earlier in the text.

    Short units that are repeated one by one may be chance; stretches of them go where a whole window does.
    """
    here: set[tuple[int, int]] = set()
    spans: list[tuple[int, int]] = []
    run: list[int] = []
    found = units(text)
    covered, ended = [False] * len(found), {}
    for first, behind, joined in windows(found):
        key = _digest(joined)
        if key in repeated or ended.setdefault(key, behind) <= first:
            covered[first:behind] = [True] * (behind - first)

    def close() -> None:
        words = [found[k][2].count(" ") + 1 for k in run]
        if sum(words) >= MIN_WORDS and max(words) >= PIECE_WORDS:
            spans.append((found[run[0]][0], found[run[-1]][1]))
        else:
            for k, n in zip(run, words, strict=True):
                if covered[k] and spans and k > run[0] and covered[k - 1]:
                    spans[-1] = (spans[-1][0], found[k][1])
                elif covered[k] or found[k][3] and n >= MIN_LINE_WORDS:
                    spans.append(found[k][:2])
        run.clear()

    for k, unit in enumerate(found):
        key = _digest(unit[2])
        if covered[k] or key in repeated or key in here:
            run.append(k)
        else:
            close()
        here.add(key)
    close()
    spans = [_widened(text, *span) for span in spans]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return "".join(kept), spans


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    """A span with the one separator that would be left over: a line's end, or the blank behind or before it."""
    opens, closes = start == 0 or text[start - 1] == "\n", end == len(text) or text[end] == "\n"
    if opens and closes:
        return (start, end + 1) if end < len(text) else (max(0, start - 1), end)
    if not closes and text[end] == " ":
        return start, end + 1
    if not opens and text[start - 1] == " " and closes:
        return start - 1, end
    return start, end


def dedup(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` without repeated units, ``removed`` (array of start and end in the original), ``n_removed``.

    What is kept is the original without the removed spans, byte for byte; a span takes the one
    separator along that it would leave behind.  Of a unit that several documents share, the document
    with the smallest id keeps the first occurrence.  Digests of 128 bits meet by group-by with map-side combining, so a line that every
    document has costs one row for each task; joins back are plain joins that Spark may split.
    Null texts stay null; rows without id keep their text and lend none; rows that repeat an id are
    copies of one document and are cut alike; an empty table gives no rows.  A document all of whose
    units go stays with the empty text.
    """
    id_type = kind(frame, id_col)
    joined = _with_repeated(frame.select(id_col, text_col), id_col, text_col)

    def make_cut():
        def row(ident, text, repeated):
            if text is None:
                return ident, None, [], 0
            left, spans = _cut(text, _keys(repeated) if ident is not None else set())
            return ident, left, [{"start": a, "end": b} for a, b in spans], len(spans)

        return row

    ddl = f"{id_col} {id_type}, text string, removed array<struct<start:long,end:long>>, n_removed long"
    return map_rows(joined, [id_col, text_col, REPEATED], ddl, make_cut, chunk=200)


def _keys(repeated) -> set[tuple[int, int]]:
    return {(x["h1"], x["h2"]) for x in repeated if x is not None} if repeated is not None else set()


def dedup_rows(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, their texts cut as by :func:`dedup`; ``n_chars``, if there, follows the text."""
    def cut(texts: pd.Series, repeated: pd.Series) -> pd.Series:
        return pd.Series(
            [x if x is None else _cut(x, _keys(r))[0] for x, r in zip(texts, repeated, strict=True)], dtype=object
        )

    joined = _with_repeated(frame, id_col, text_col)
    out = joined.withColumn(text_col, F.pandas_udf(cut, "string")(F.col(text_col), F.col(REPEATED)))
    if "n_chars" in frame.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out.select(*frame.columns)


def _with_repeated(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with the digests of those units that a document of smaller id has."""
    id_type = kind(frame, id_col)
    scratch = Scratch(frame.sparkSession)

    def make_units():
        def row(ident, text):
            if ident is None:
                return []
            found = units(text or "")
            return [(ident, *key) for key in {_digest(u[2]) for u in [*found, *windows(found)]}]

        return row

    seen = scratch.write(
        flat_map_rows(frame, [id_col, text_col], f"unit_of {id_type}, h1 long, h2 long", make_units), "units"
    )
    shared = (
        seen.groupBy("h1", "h2")
        .agg(F.min("unit_of").alias("first"), F.max("unit_of").alias("last"))
        .filter("first < last")
        .select("h1", "h2", "first")
    )
    later = seen.join(shared, ["h1", "h2"]).filter("unit_of > first").select("unit_of", "h1", "h2")
    sets = later.groupBy(F.col("unit_of").alias("__unit_of")).agg(F.collect_list(F.struct("h1", "h2")).alias(REPEATED))
    return frame.join(sets, F.col(id_col) == F.col("__unit_of"), "left").drop("__unit_of")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
