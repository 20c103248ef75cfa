"""Quality rules as a short-circuit cascade (operator 8)."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import kind
from .common import flat_map_rows, map_rows, read

#: Rows whose rules are timed to order the cascade; the order never changes a verdict.
SAMPLE_ROWS = 400
_BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
_SYMBOLS = "#*$%&|<>"
_LETTER = re.compile(r"[^\W\d_]")


class Measures:
    """What the rules look at; each measure is taken once and only when a rule asks for it."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes.split knows ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(_BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.translate(_BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        windows = list(zip(self.words, self.words[1:], self.words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen, covered, until = Counter(windows), 0, 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                covered += at + 3 - max(at, until)
                until = at + 3
        return covered

    @cached_property
    def letter_words(self) -> int:
        return sum(x.isalpha() or bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Limits:
    """Above (or, for ``least``, below) these a document goes."""

    symbols_per_word: float = 0.1
    dup_lines: float = 0.3
    least_word_length: float = 2.0
    most_word_length: float = 15.0
    least_letter_words: float = 0.6
    ellipsis_lines: float = 0.5
    capitals: float = 0.7


def rules(limits: Limits) -> dict[str, Callable[[Measures], bool]]:
    """Rejecting rules by name; all are independent of each other, so their order is free."""
    return {
        "symbols": lambda m: m.n_symbols > limits.symbols_per_word * m.n_words,
        "dup_lines": lambda m: m.n_dup_lines > limits.dup_lines * len(m.lines),
        "short_words": lambda m: m.word_chars < limits.least_word_length * m.n_words,
        "long_words": lambda m: m.word_chars > limits.most_word_length * m.n_words,
        "letters": lambda m: m.letter_words < limits.least_letter_words * m.n_words,
        "ellipsis": lambda m: sum(x.rstrip().endswith(("...", "…")) for x in m.lines)
        > limits.ellipsis_lines * len(m.lines),
        "capitals": lambda m: sum(map(str.isupper, m.text)) > limits.capitals * m.word_chars,
        "base": lambda m: m.base_failed,
    }


def plan_cascade(frame: DataFrame, text_col: str, limits: Limits) -> list[str]:
    """Rule names by rejections per second on the first ``SAMPLE_ROWS`` rows.

    A sample without rejections by a rule counts half a rejection, so that cheap rules still lead.
    """

    def make():
        own = rules(limits)

        def row(text):
            out = []
            for name, rule in own.items():
                fresh, began = Measures(text), time.perf_counter_ns()
                out.append((name, int(rule(fresh)), time.perf_counter_ns() - began))
            return out

        return row

    timed = flat_map_rows(
        frame.select(text_col).limit(SAMPLE_ROWS), [text_col], "rule string, rejected long, cost long", make
    )
    seen = timed.groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("cost").alias("cost")).collect()
    worth = {r["rule"]: (r["rejected"] + 0.5) / max(r["cost"], 1) for r in seen}
    return sorted(rules(limits), key=lambda name: -worth.get(name, 0.0))


def _verdict(order: list[str], limits: Limits) -> Callable[[Measures], bool]:
    own = rules(limits)
    cascade = [own[name] for name in order]
    return lambda m: not any(rule(m) for rule in cascade)


def measure(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None
) -> DataFrame:
    """Base measures and the cascade's verdict for each row.

    A null text is an empty one and fails the base rule; repeated rows are judged one by one; an
    empty table gives no rows; columns other than the two named are not read.
    """
    limits = limits or Limits()
    order = plan_cascade(frame, text_col, limits)

    def make():
        verdict = _verdict(order, limits)

        def row(ident, text):
            m = Measures(text)
            kept = verdict(m)
            return (
                ident, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, kept,
            )

        return row

    ddl = (
        f"{id_col} {kind(frame, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, base_failed boolean, kept boolean"
    )
    return map_rows(frame, [id_col, text_col], ddl, make)


def keep_good(frame: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows that the cascade keeps, all columns as they are; each row runs only as far as its first rejection."""
    limits = limits or Limits()
    order = plan_cascade(frame, text_col, limits)
    return frame.filter(_keeps(order, limits)(F.col(text_col)))


def _keeps(order: list[str], limits: Limits) -> Callable[[Column], Column]:
    def verdicts(texts: pd.Series) -> pd.Series:
        verdict = _verdict(order, limits)
        return pd.Series([verdict(Measures(x)) for x in texts], dtype=bool)

    return F.pandas_udf(verdicts, "boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents"))
