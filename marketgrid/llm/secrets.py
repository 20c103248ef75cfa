"""Secret scans: base patterns and a randomness battery with false-discovery control (operator 5)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import kind
from .common import Scratch, arrow_schema, map_rows, read

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Encodings by falling strictness, with the characters of each.
ENCODINGS = (
    (re.compile(r"[0-9]+"), 10),
    (re.compile(r"[0-9a-f]+"), 16),
    (re.compile(r"[0-9A-F]+"), 16),
    (re.compile(r"[A-Z2-7]+"), 32),
    (re.compile(r"[a-z0-9]+"), 36),
    (re.compile(r"[A-Z0-9]+"), 36),
    (re.compile(r"[A-Za-z0-9]+"), 62),
    (re.compile(r"[A-Za-z0-9+/_-]+=*"), 64),
)
#: False-discovery rate, level at which the battery rejects uniform randomness, and length bands' lower ends.
RATE, LEVEL, BANDS = 0.01, 1e-3, (16, 20, 24, 32, 48, 64)
#: Strings of ordinary text drawn for each band to learn what the battery says of them, and steps of its p-values.
DRAWS, DRAWS_PER_TASK, STEPS = 20_000, 1_000, 1_000
_CODES = np.full(256, 64, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
    _CODES[ord(_c)] = _k
_CODES[ord("-")], _CODES[ord("_")] = 62, 63
_ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
              36: "abcdefghijklmnopqrstuvwxyz0123456789"}


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, size: int) -> float:
    """Fisher's combination of three p-values that uniform characters of an alphabet pass.

    Chi-squared for uniformity (Wilson-Hilferty), Wald-Wolfowitz runs about the alphabet's middle and
    lag-one serial correlation, the last two two-sided.
    """
    letters = _ALPHABETS.get(size)
    body = token.rstrip("=")
    if letters:
        codes = [letters.find(c) if c in letters else letters.find(c.swapcase()) for c in body]
    else:
        codes = [int(_CODES[ord(c)]) for c in body]
    n = len(codes)
    counts = np.bincount(codes, minlength=size)
    chi2 = float((counts * counts).sum()) * size / n - n
    df = size - 1
    p_uniform = _upper_tail(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [c * 2 >= size for c in codes]
    n1 = sum(high)
    n2 = n - n1
    if n1 and n2:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    x = np.array(codes, float) - sum(codes) / n
    spread = float((x * x).sum())
    r = float((x[1:] * x[:-1]).sum()) / spread if spread else 1.0
    p_serial = 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def encoding(token: str) -> int:
    """Characters of the strictest encoding that can hold a token."""
    return next(size for pattern, size in ENCODINGS if pattern.fullmatch(token))


#: Candidates that a task keeps at hand to send each once.
TOKENS = 50_000


def pair_counts(frame: DataFrame, text_col: str) -> np.ndarray:
    """Counts of neighbouring characters over all texts, 65 x 65 (the last class is any other character).

    Each distinct candidate counts once, however many texts hold it, so that copies of a secret don't
    make it ordinary text; candidates are combined by task before the shuffle.
    """
    spark_schema, schema = arrow_schema("pair int, n long, token string")

    def rows(total: np.ndarray, tokens: set[str]) -> pa.RecordBatch:
        used = np.flatnonzero(total)
        pairs, n = np.r_[used, np.full(len(tokens), -1)], np.r_[total[used], np.ones(len(tokens), np.int64)]
        named = [None] * len(used) + list(tokens)
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(n, pa.int64()), pa.array(named, pa.string())], schema=schema)

    def count(total: np.ndarray, text: str) -> None:
        codes = _CODES[np.frombuffer(text.encode(), np.uint8)]
        if len(codes) > 1:
            total += np.bincount(codes[:-1] * 65 + codes[1:], minlength=65 * 65)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(65 * 65, np.int64), set()

        def take(m: re.Match) -> str:
            tokens.add(m[0])
            return " "

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count(total, CANDIDATE.sub(take, text or ""))
                if len(tokens) >= TOKENS:
                    yield rows(np.zeros(65 * 65, np.int64), tokens)
                    tokens.clear()
        yield rows(total, tokens)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65 * 65, np.int64)
        for batch in batches:
            for pair, n, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if token is None:
                    total[pair] += n
                else:
                    count(total, token)
        yield rows(total, set())

    seen = frame.select(text_col).mapInArrow(texts, spark_schema).groupBy("pair", "token").agg(F.sum("n").alias("n"))
    found = seen.select("pair", "n", "token").mapInArrow(once, spark_schema).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(65 * 65)
    for r in found:  # at most 65 * 65
        counts[r["pair"]] = r["n"]
    return counts.reshape(65, 65)


def text_model(pairs: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log probabilities of a character after another in ordinary text.

    Each count leaves one occurrence out, the one being judged, so that a rare pair does not vouch for itself;
    pairs are drawn towards the characters' own frequencies by ``weight`` observations.
    """
    single = np.maximum(pairs.sum(0) - 1, 0) + 0.5
    single /= single.sum()
    return np.log(
        (np.maximum(pairs - 1, 0) + weight * single[None, :]) / (np.maximum(pairs.sum(1, keepdims=True) - 1, 0) + weight)
    )


def null_counts(spark: SparkSession, log_text: np.ndarray) -> np.ndarray:
    """How often, by length band, strings of ordinary text get a combined p-value of the battery in a step or above.

    The strings are drawn, at each band's least length, character by character from the corpus's own pairs.
    """
    chain = np.cumsum(np.exp(log_text[:64, :64] - log_text[:64, :64].max(1, keepdims=True)), axis=1)
    chain /= chain[:, -1:]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))
    per_band = DRAWS // DRAWS_PER_TASK

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.id:
                band, rng = int(part) // per_band, np.random.default_rng(int(part))
                at = rng.integers(0, 64, DRAWS_PER_TASK)
                drawn = []
                for _ in range(8 + BANDS[band]):  # the first few only forget where the chain began
                    at = (chain[at] < rng.random(DRAWS_PER_TASK)[:, None]).sum(1).clip(max=63)
                    drawn.append(letters[at])
                tokens = ["".join(x) for x in np.stack(drawn[8:], 1)]
                steps = [_step(battery(t, encoding(t))) for t in tokens]
                yield pd.DataFrame({"band": band, "step": steps}).value_counts().reset_index(name="n")

    drawn = spark.range(0, len(BANDS) * per_band, 1, len(BANDS) * per_band // 4).mapInPandas(draw, "band int, step int, n long")
    counts = np.zeros((len(BANDS), STEPS + 1))
    for r in drawn.groupBy("band", "step").agg(F.sum("n").alias("n")).collect():  # at most bands x steps
        counts[r["band"], r["step"]] = r["n"]
    return counts[:, ::-1].cumsum(1)[:, ::-1]


def _step(p: float) -> int:
    return int(min(p, 1.0) * STEPS)


def span_finder(log_text: np.ndarray, null: np.ndarray):
    """A function from a text to its base counts, base spans and tested candidates.

    Two p-values for "ordinary text" meet in a candidate: how likely the corpus's character pairs are to
    give it against its encoding (the inverse of a likelihood ratio), and how often ordinary text
    of its length looks as random to the battery.  As they depend on each other they are combined by
    the geometric mean times e, which is valid for any dependence.
    """
    share = math.log(len(ENCODINGS))

    def row(text):
        text = text or ""
        assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        access = [m.span() for m in ACCESS.finditer(text)]
        hexes = [m.span() for m in HEX.finditer(text)]
        base = sorted((s, k, e) for k, of in enumerate((assign, access, hexes)) for s, e in of)
        tested, ahead, covered = [], 0, 0  # base spans that begin before the candidate's end, and where the last of them ends
        for m in CANDIDATE.finditer(text):
            token = m[0]
            start, end = m.span()
            while ahead < len(base) and base[ahead][0] < end:
                covered = max(covered, base[ahead][2])
                ahead += 1
            if covered > start:
                continue
            size = encoding(token)
            codes = _CODES[np.frombuffer(token.rstrip("=").encode(), np.uint8)]
            evidence = -float(log_text[codes[:-1], codes[1:]].sum()) - (len(codes) - 1) * math.log(size) - share
            uniform = battery(token, size)
            band = sum(len(token) >= b for b in BANDS)
            if uniform < LEVEL:
                score = 0.0
            else:
                among_text = (1 + null[band - 1, _step(uniform)]) / (1 + null[band - 1, 0])
                score = (max(evidence, 0.0) - math.log(among_text)) / 2 - 1
            tested.append({"start": start, "end": end, "band": band, "score": min(max(int(score * 10), 0), 5000)})
        named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        return len(assign), len(access), len(hexes), named, tested

    return row


def scan(frame: DataFrame, id_col: str, text_col: str, log_text: np.ndarray, null: np.ndarray) -> DataFrame:
    """Base spans and tested candidates of each text; a score is -10 ln of the combined p-value."""

    def make():
        row = span_finder(log_text, null)
        return lambda ident, text: (ident, *row(text))

    ddl = (
        f"{id_col} {kind(frame, id_col)}, n_assign long, n_access long, n_hex long, base string,"
        " tested array<struct<start:long,end:long,band:int,score:int>>"
    )
    return map_rows(frame, [id_col, text_col], ddl, make)


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg by length band over all candidates: the least evidence that counts as found.

    The rows that reach the driver are one for each band and score, however many candidates.
    """
    counts = (
        scanned.select(F.explode("tested").alias("t"))
        .groupBy("t.band", "t.score")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    out = {}
    for band in {r["band"] for r in counts}:
        steps = sorted(((r["score"], r["n"]) for r in counts if r["band"] == band), reverse=True)
        total, found = sum(n for _, n in steps), 0
        for step, n in steps:
            found += n
            if step and math.exp(-step / 10) <= RATE * found / total:
                out[band] = step
    return out


def find(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of base spans and all spans of each text.

    Spans are code points, end exclusive.  Base spans come from the patterns alone; the battery adds
    ``random`` spans that overlap none of them: characters that pass as uniform draws of the
    strictest fitting encoding and whose combined p-value (:func:`span_finder`) ordinary text would
    not give, at a false-discovery rate held within length bands over the whole corpus.  A null text is empty; repeated rows are scanned one
    by one; an empty table gives no rows.
    """
    log_text = text_model(pair_counts(frame, text_col))
    null = null_counts(frame.sparkSession, log_text)
    scratch = Scratch(frame.sparkSession)
    scanned = scratch.write(scan(frame, id_col, text_col, log_text, null), "scanned")
    least = thresholds(scanned)

    def make():
        def row(ident, n_assign, n_access, n_hex, base, tested):
            spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
            spans += [
                (t["start"], 3, t["end"])
                for t in tested
                if t["band"] in least and t["score"] >= least[t["band"]]
            ]
            spans.sort()
            named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            return ident, n_assign, n_access, n_hex, hashlib.sha256(base.encode()).hexdigest(), named

        return row

    ddl = f"{id_col} {kind(frame, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_rows(scanned, scanned.columns, ddl, make)


def redact(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with every found span replaced by ``mask`` (overlaps as one)."""
    log_text = text_model(pair_counts(frame, text_col))
    null = null_counts(frame.sparkSession, log_text)
    # The battery looks at the same rows twice, first for the thresholds, so no join brings spans back to texts.
    least = thresholds(scan(frame, id_col, text_col, log_text, null))

    def masked(text: str | None, base: str, tested: list[dict]) -> str | None:
        spans = [(int(s), int(e)) for _, s, e in (x.split(":") for x in base.split(",") if x)]
        spans += [(t["start"], t["end"]) for t in tested if t["band"] in least and t["score"] >= least[t["band"]]]
        if not spans:
            return text
        out, at = [], 0
        for start, end in sorted(spans):
            if start >= at:
                out.append(text[at:start] + mask)
            at = max(at, end)
        return "".join(out) + text[at:]

    return frame.withColumn(text_col, _mask_udf(log_text, null, masked)(F.col(text_col)))


def _mask_udf(log_text: np.ndarray, null: np.ndarray, masked):
    def run(texts: pd.Series) -> pd.Series:
        row = span_finder(log_text, null)
        return pd.Series([x if x is None else masked(x, *row(x)[3:]) for x in texts], dtype=object)

    return F.pandas_udf(run, "string")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
