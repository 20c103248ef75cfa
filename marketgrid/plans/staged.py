"""Queries made of stages of named SQL expressions.

Each stage adds columns to a frame; Spark runs them as ``selectExpr``, and the same text over the
same stages, nested as sub-selects, is what the oracle runs.  Stages over one window specification
share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import sql

Source = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Staged:
    """``source`` rows, then ``stages`` of {column: expression}, then ``where``, then ``select`` columns."""

    source: Source
    ctes: tuple[str, ...]
    relation: str
    select: dict[str, str]
    stages: tuple[dict[str, str], ...] = ()
    where: str | None = None
    group: tuple[str, ...] = ()
    extra: dict[str, Source] = field(default_factory=dict)
    #: Adds the columns of the first ``ready_stages`` stages at less cost than their windows.
    ready: Callable[[DataFrame], DataFrame] | None = None
    ready_stages: int = 0

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.source(spark, sf_dir)
        if self.ready:
            out = self.ready(out)
        for stage in self.stages[self.ready_stages :]:
            out = out.selectExpr("*", *(f"{e} AS {name}" for name, e in stage.items()))
        if self.where:
            out = out.filter(self.where)
        if self.group:
            from pyspark.sql import functions as F

            return out.groupBy(*self.group).agg(
                *(F.expr(e).alias(name) for name, e in self.select.items() if name not in self.group)
            )
        return out.selectExpr(*(f"{e} AS {name}" for name, e in self.select.items()))

    def oracle(self) -> str:
        relation = self.relation
        for stage in self.stages:
            relation = f"(SELECT *, {', '.join(f'{e} AS {name}' for name, e in stage.items())} FROM {relation})"
        text = sql.with_(*self.ctes) if self.ctes else ""
        text += f"SELECT {', '.join(f'{e} AS {name}' for name, e in self.select.items())} FROM {relation}"
        if self.where:
            text += f" WHERE {self.where}"
        if self.group:
            text += f" GROUP BY {', '.join(self.group)}"
        return text


#: What is added before rounding, so that halves go up in either engine.
HALF = "1e-9"


def rounded(names: list[str], digits: int = 6) -> dict[str, str]:
    return {name: f"round({name} + {HALF}, {digits})" for name in names}
