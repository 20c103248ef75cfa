"""Column expressions for symbols, flags, reasons, costs and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons are listed in the order in which masks are given.
PREFIX_EXCHANGE = (("6", "SH"), ("9", "SH"), ("0", "SZ"), ("2", "SZ"), ("3", "SZ"), ("4", "BJ"), ("8", "BJ"))


def normalise_symbol(raw: Column) -> Column:
    """``SH600519``, ``600519.SH``, ``sh.600000`` or ``600519`` to ``NNNNNN.EX``; null if it has no six digits."""
    text = F.upper(F.trim(raw))
    digits = F.regexp_extract(text, r"([0-9]{6})", 1)
    given = F.regexp_extract(text, r"(SH|SZ|BJ)", 1)
    guessed = F.lit(None).cast("string")
    for prefix, exchange in reversed(PREFIX_EXCHANGE):
        guessed = F.when(digits.startswith(prefix), exchange).otherwise(guessed)
    return F.when(digits != "", F.concat(digits, F.lit("."), F.when(given != "", given).otherwise(guessed)))


def scope_reason(symbol: Column) -> Column:
    """Why a normalised symbol is out of scope; null if it is in."""
    return (
        F.when(symbol.isNull(), "invalid")
        .when(symbol.endswith(".BJ"), "excluded_exchange")
        .when(~symbol.rlike(r"^(6[0-9]{5}\.SH|[03][0-9]{5}\.SZ)$"), "not_a_share")
    )


def market_board(symbol: Column) -> Column:
    return (
        F.when(symbol.startswith("688"), "STAR")
        .when(symbol.startswith("30"), "ChiNext")
        .when(symbol.endswith(".BJ"), "Beijing")
        .when(symbol.rlike("^(60|00)"), "Main")
        .otherwise("Other")
    )


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def reasons(**masks: Column) -> Column:
    """Names of the masks that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(m, F.lit(name)) for name, m in masks.items()))))


def tick(x: Column) -> Column:
    """Half-up rounding to the price tick."""
    return F.round(x, 2)


# Upper ends of the 20-day mean traded amount and the slippage per side there; beyond them the last; and the fee rates.
IMPACT_TIERS = ((20_000_000, 0.0025), (50_000_000, 0.0015), (200_000_000, 0.0008), (1_000_000_000, 0.0005))
DEEPEST = 0.0003
COMMISSION, MIN_COMMISSION, SELL_TAX = 0.0003, 5.0, 0.0005


def slippage_rate(mean_amount: Column) -> Column:
    """Slippage by liquidity tier of the mean traded amount; an unknown or invalid amount pays as the least liquid."""
    rate = F.when(mean_amount.isNull() | F.isnan(mean_amount) | (mean_amount <= 0), IMPACT_TIERS[0][1])
    for most, of in IMPACT_TIERS:
        rate = rate.when(mean_amount <= most, of)
    return rate.otherwise(DEEPEST)


def fee(side: Column, notional: Column, times: Column | float = 1.0) -> Column:
    """Commission with a minimum, and tax on sells only; stress scales the commission, never the tax."""
    return F.greatest(notional * COMMISSION * times, F.lit(MIN_COMMISSION)) + F.when(side == "SELL", notional * SELL_TAX).otherwise(0.0)


def direction(down: Column, flat: Column, up: Column) -> Column:
    """The single most likely class; ties and invalid probabilities wait."""
    top = F.greatest(down, flat, up)
    ties = (down == top).cast("int") + (flat == top).cast("int") + (up == top).cast("int")
    valid = (F.abs(down + flat + up - 1) < 1e-6) & (F.least(down, flat, up) >= 0)
    return F.when(~valid | (ties > 1), "WAIT").when(up == top, "BUY").when(down == top, "SELL").otherwise("WAIT")
