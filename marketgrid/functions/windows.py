"""Text of window expressions over a symbol's bars, in date order, by rows."""

from __future__ import annotations

BY_SYMBOL = "PARTITION BY symbol ORDER BY date"


def frame(n: int, lag: int = 0) -> str:
    """The last ``n`` rows, the latest of them ``lag`` rows back."""
    end = f"{lag} PRECEDING" if lag else "CURRENT ROW"
    return f"OVER ({BY_SYMBOL} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {end})"


def ahead(n: int) -> str:
    """The next ``n`` rows, without this one."""
    return f"OVER ({BY_SYMBOL} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def full(function: str, x: str, n: int, lag: int = 0, least: int | None = None) -> str:
    """An aggregate over a frame that holds ``least`` (all ``n``) known values; null otherwise."""
    over = frame(n, lag)
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {function}({x}) {over} END"


def prior(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY_SYMBOL})"


def later(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({BY_SYMBOL})"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"
