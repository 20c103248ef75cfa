"""BPE encoding and decoding over a table of texts (operator 1)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .bpe_automaton import automaton
from .common import map_rows, read, vocabulary_path


def encode(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of token ids) of each row's whole text.

    A null or empty text has no ids.  The rows stay where they are: no shuffle, any number of
    repeated rows, other columns are not read.
    """
    path = vocabulary or vocabulary_path()

    def make():
        pack = automaton(path).encode_packed
        return lambda ident, text: (ident, np.frombuffer(pack(text or ""), "<u4").astype(np.int32))

    return map_rows(frame, [id_col, text_col], f"{id_col} {kind(frame, id_col)}, ids array<int>", make)


def decode(frame: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of each row's ids; null ids decode to the empty text, unknown ids to nothing."""
    path = vocabulary or vocabulary_path()

    def make():
        coder = automaton(path)

        def row(ident, ids):
            known = [i for i in ids or [] if i is not None and 0 <= i < len(coder.labels)]
            return ident, coder.decode_packed(np.array(known, "<u4").tobytes())

        return row

    return map_rows(frame, [id_col, ids_col], f"{id_col} {kind(frame, id_col)}, text string", make)


def kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def round_trip(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Digests of each text's ids and of what they decode to, in one pass over the table."""
    path = vocabulary or vocabulary_path()

    def make():
        coder = automaton(path)

        def row(ident, text):
            packed = coder.encode_packed(text or "")
            decoded = coder.decode_packed(packed)
            return (
                ident,
                len(packed) // 4,
                hashlib.sha256(packed).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )

        return row

    ddl = f"{id_col} {kind(frame, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(frame, [id_col, text_col], ddl, make)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
