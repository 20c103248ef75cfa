"""Causal trailing features of a symbol's bars.

A value at a session uses rows up to that session only, and is null until its window is full.  All
windows of a query share the partitioning by symbol and the order by date, so Spark shuffles and
sorts the bars once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.windows import BY_SYMBOL, ahead, frame, full, later, prior, ratio
from ..plans import sql
from ..plans.staged import Staged, rounded
from ..sources.tables import bars_daily

KEY = {"symbol": "symbol", "date": "date"}


def bars(select: list[str], *stages: dict[str, str], digits: int = 6, where: str | None = None, plain: tuple[str, ...] = ()) -> Staged:
    """A query on daily bars that returns the key, rounded ``select`` columns and ``plain`` ones."""
    ready = ranged if stages[: len(RANGE_STAGES)] == RANGE_STAGES else None
    return Staged(
        bars_daily, (sql.BARS,), "bars", KEY | rounded(select, digits) | {p: p for p in plain}, stages, where,
        ready=ready, ready_stages=len(RANGE_STAGES) if ready else 0,
    )


RETURNS = {f"ret_{n}": f"{ratio('close', prior('close', n))} - 1" for n in (1, 5, 20)}
AVERAGES = {f"ma{n}": full("avg", "close", n) for n in (5, 10, 20, 60)}
PREVIOUS = {"prev_close": prior("close")}
TRUE_RANGE = {"true_range": "greatest(high - low, abs(high - prev_close), abs(low - prev_close))"}
ATR_PRIOR = {"atr": f"nullif({full('avg', 'true_range', 14, 1)}, 0)"}
PRIOR_RANGE = {
    "high60": full("max", "high", 60, 1, 40),
    "low60": full("min", "low", 60, 1, 40),
    "high20": full("max", "high", 20, 1),
    "low20": full("min", "low", 20, 1),
    "mean20": f"nullif({full('avg', 'volume', 20, 1)}, 0)",
    "amount20": f"nullif({full('avg', 'amount', 20, 1)}, 0)",
    "up_volume": "CASE WHEN close > prev_close THEN volume ELSE 0 END",
    "down_volume": "CASE WHEN close < prev_close THEN volume ELSE 0 END",
    "up_day": "CASE WHEN close > prev_close THEN 1 ELSE 0 END",
    "down_day": "CASE WHEN close < prev_close THEN 1 ELSE 0 END",
    "vol5": full("avg", "volume", 5),
    "vol5_before": full("avg", "volume", 5, 5),
}
WIDTH = {
    "width": "nullif(high60 - low60, 0)",
    "up20": full("sum", "up_volume", 20, 1),
    "down20": full("sum", "down_volume", 20, 1),
    "up_days": full("sum", "up_day", 20, 1),
    "down_days": full("sum", "down_day", 20, 1),
}
BAR_SHAPE = {
    "spread_atr": "(high - low) / atr",
    "body_atr": "(close - open) / atr",
    "close_location": "CASE WHEN high = low THEN 0.5 ELSE (close - low) / nullif(high - low, 0) END",
    "upper_shadow": "CASE WHEN high = low THEN 0 ELSE (high - greatest(open, close)) / nullif(high - low, 0) END",
    "lower_shadow": "CASE WHEN high = low THEN 0 ELSE (least(open, close) - low) / nullif(high - low, 0) END",
    "gap_atr": "(open - prev_close) / atr",
    "relative_volume20": "volume / mean20",
    "volume5_to20": "vol5 / mean20",
    "relative_amount20": "amount / amount20",
    "up_down_volume20": "CASE WHEN down20 IS NOT NULL THEN up20 / greatest(down20, 1) END",
    "divergence": "((close - prev_close) / atr) / nullif(volume / mean20, 0)",
    "pullback_push20": "CASE WHEN up20 IS NOT NULL AND down20 IS NOT NULL THEN (down20 / greatest(down_days, 1)) / greatest(up20 / greatest(up_days, 1), 1) END",
    "contraction5": "vol5 / nullif(vol5_before, 0)",
    "range_width_atr": "width / atr",
    "range_position": "(close - low60) / width",
    "support_distance": "(close - low60) / atr",
    "resistance_distance": "(high60 - close) / atr",
    "compression20_60": "(high20 - low20) / width",
    "down_probe": "CASE WHEN low60 IS NOT NULL THEN greatest(low60 - low, 0) / atr END",
    "up_probe": "CASE WHEN high60 IS NOT NULL THEN greatest(high - high60, 0) / atr END",
}
RANGE_STAGES = (PREVIOUS, TRUE_RANGE, ATR_PRIOR | PRIOR_RANGE, WIDTH)
#: What :func:`ranged` adds: the columns of ``RANGE_STAGES``, and how many highs the prior range knows.
RANGED = (
    "prev_close double, true_range double, atr double, high60 double, low60 double, high20 double, low20 double, mean20 double, amount20 double,"
    " up_volume double, down_volume double, up_day int, down_day int, vol5 double, vol5_before double, width double, up20 double, down20 double,"
    " up_days long, down_days long, range_count int"
)


def _slid(x: np.ndarray, of: np.ufunc, n: int, lag: int = 0, least: int | None = None) -> np.ndarray:
    """``of`` over the known ones of the last ``n`` values that end ``lag`` rows back, from the oldest to the newest; not a number below ``least`` (all) of them."""
    rows, known = len(x), ~np.isnan(x)
    past = np.r_[np.full(n - 1 + lag, np.nan), x][: rows + n - 1]
    seen = np.r_[np.zeros(n + lag, np.int64), np.cumsum(known)]
    count = seen[n : n + rows] - seen[:rows]
    out = np.full(rows, 0.0 if of is np.add else np.nan)
    for k in range(n):
        step = past[k : k + rows]
        out = out + np.where(np.isnan(step), 0.0, step) if of is np.add else of(out, step)
    return np.where(count >= (n if least is None else least), out, np.nan)


def range_columns(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, amount: np.ndarray) -> dict[str, np.ndarray]:
    """``RANGE_STAGES`` of a symbol's bars in date order, frame by frame for all bars at once; nulls are not numbers."""
    mean = lambda x, n, lag=0: _slid(x, np.add, n, lag) / n
    some = lambda x: np.where(x == 0, np.nan, x)
    before = np.r_[np.nan, close[:-1]]
    true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    up, down = close > before, close < before
    found = {
        "prev_close": before, "true_range": true_range, "atr": some(mean(true_range, 14, 1)),
        "high60": _slid(high, np.fmax, 60, 1, 40), "low60": _slid(low, np.fmin, 60, 1, 40), "high20": _slid(high, np.fmax, 20, 1), "low20": _slid(low, np.fmin, 20, 1),
        "mean20": some(mean(volume, 20, 1)), "amount20": some(mean(amount, 20, 1)), "up_volume": np.where(up, volume, 0.0), "down_volume": np.where(down, volume, 0.0),
        "up_day": up.astype(float), "down_day": down.astype(float), "vol5": mean(volume, 5), "vol5_before": mean(volume, 5, 5),
    }
    found["width"] = some(found["high60"] - found["low60"])
    found |= {name: _slid(found[x], np.add, 20, 1) for name, x in (("up20", "up_volume"), ("down20", "down_volume"), ("up_days", "up_day"), ("down_days", "down_day"))}
    return found | {"range_count": _slid((~np.isnan(high)).astype(float), np.add, 60, 1, 0)}


def ranged(bars: DataFrame) -> DataFrame:
    """Bars with the columns of ``RANGE_STAGES``, each frame once over a symbol's bars, some thousands, in place of once for each bar."""
    schema = T.StructType([*bars.schema, *T.StructType.fromDDL(RANGED)])
    kinds, given, added = to_arrow_schema(schema), bars.columns, [x.split()[0] for x in RANGED.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        found = range_columns(*(rows[c].to_numpy().astype(float) for c in ("high", "low", "close", "volume", "amount")))
        columns = [pa.array(found[x], from_pandas=True).cast(kinds.field(x).type) for x in added]
        return pa.Table.from_arrays([rows[c].combine_chunks() for c in given] + columns, schema=kinds)

    return bars.groupBy("symbol").applyInArrow(run, schema)


VALID_RANGE = {"in_range": "CASE WHEN width / atr <= 20 AND prev_close >= low60 AND prev_close <= high60 THEN 1 ELSE 0 END"}
BAD = {"bad": "CASE WHEN verified = 1 AND volume > 0 AND high >= low AND close > 0 THEN 0 ELSE 1 END"}
def clamp(x: str, low: str = "0", high: str = "1") -> str:
    """Null stays null: ``greatest`` and ``least`` pass over it."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, {x})) END"


# Weights of location, change, body and wick, and what a reversal and a dry-up add.
WEIGHTS, REVERSAL, DRY_UP, LIVELY = (0.35, 0.30, 0.20, 0.15), 0.15, 0.10, 0.8


def _pressure(side: int) -> str:
    """Score of one side in [0, 1]: how the bar leans, by how much takes part, plus a turn against the bar before and a quiet bar that holds."""
    lean, (place, change, body, wick) = ("" if side > 0 else "-"), WEIGHTS
    shadow = "lower_shadow" if side > 0 else "upper_shadow"
    leaning = " + ".join(f"{w} * greatest({lean}{x}, 0)" for w, x in ((place, "placed"), (change, "changed"), (body, "bodied")))
    turn = "close > prev_high AND prev_close < prev_open" if side > 0 else "close < prev_low AND prev_close > prev_open"
    quiet = "close < prev_close AND placed >= 0 AND low >= low20" if side > 0 else "close > prev_close AND placed <= 0 AND high <= high20"
    score = f"({leaning} + {wick} * {shadow}) * (0.5 + 0.25 * greatest(0, least(2, relative_volume20)))"
    score += f" + CASE WHEN {turn} AND relative_volume20 >= {LIVELY} THEN {REVERSAL} ELSE 0 END"
    score += f" + CASE WHEN {quiet} AND relative_volume20 <= {LIVELY} THEN {DRY_UP} ELSE 0 END"
    return f"CASE WHEN atr > 0 AND relative_volume20 > 0 AND changed IS NOT NULL THEN greatest(0, least(1, {score})) END"


SCORE_STAGES = (
    {
        "prev_high": prior("high"), "prev_low": prior("low"), "prev_open": prior("open"),
        "placed": "CASE WHEN high > low THEN (2 * close - high - low) / (high - low) ELSE 0 END",
        "changed": clamp("(close - prev_close) / atr", "-1"), "bodied": clamp("(close - open) / atr", "-1"),
    },
    {"demand": _pressure(1), "supply": _pressure(-1)},
)

PLANS: dict[str, Staged] = {
    "w01_returns": bars(list(RETURNS), RETURNS),
    "w02_averages": bars(
        [*AVERAGES, *(f"ma{n}_{k}" for n in (5, 10, 20, 60) for k in ("bias", "slope5"))],
        AVERAGES,
        {f"ma{n}_bias": f"close / ma{n} - 1" for n in (5, 10, 20, 60)}
        | {f"ma{n}_slope5": f"{ratio(f'ma{n}', prior(f'ma{n}', 5))} - 1" for n in (5, 10, 20, 60)},
    ),
    "w03_alignment": bars(
        ["ma_alignment", "close_above_ma20", "gap5_10", "gap10_20", "gap20_60"],
        AVERAGES,
        {
            "ma_alignment": "(sign(ma5 - ma10) + sign(ma10 - ma20) + sign(ma20 - ma60)) / 3.0",
            "close_above_ma20": "sign(close - ma20)",
            "gap5_10": "ma5 / ma10 - 1",
            "gap10_20": "ma10 / ma20 - 1",
            "gap20_60": "ma20 / ma60 - 1",
        },
    ),
    "w04_atr": bars(
        ["true_range", "atr14_ratio"], PREVIOUS, TRUE_RANGE, {"atr14_ratio": f"({full('avg', 'true_range', 14)}) / close"}
    ),
    "w05_volatility": bars(["volatility20"], {"ret_1": RETURNS["ret_1"]}, {"volatility20": full("stddev_pop", "ret_1", 20)}),
    "w06_drawdown": bars(
        ["drawdown20", "drawdown60"],
        {f"drawdown{n}": f"close / ({full('max', 'close', n)}) - 1" for n in (20, 60)},
    ),
    "w07_volume_ratios": bars(
        ["vol_ratio5", "vol_ratio20", "vol_ma5_to20", "amount_ratio20", "amount_ma5_to20"],
        {f"vol_ratio{n}": ratio("volume", full("avg", "volume", n, 1)) for n in (5, 20)}
        | {
            "vol_ma5_to20": ratio(full("avg", "volume", 5), full("avg", "volume", 20)),
            "amount_ratio20": ratio("amount", full("avg", "amount", 20, 1)),
            "amount_ma5_to20": ratio(full("avg", "amount", 5), full("avg", "amount", 20)),
        },
    ),
    "w08_up_down_volume": bars(
        ["up_volume_ratio", "down_volume_ratio", "up_expansion", "pullback_contraction"],
        {"ret_1": RETURNS["ret_1"], "vol_ratio20": ratio("volume", full("avg", "volume", 20, 1))},
        {
            "up_volume_ratio": "CASE WHEN ret_1 > 0 THEN vol_ratio20 ELSE 0 END",
            "down_volume_ratio": "CASE WHEN ret_1 < 0 THEN vol_ratio20 ELSE 0 END",
            "up_expansion": "CASE WHEN ret_1 > 0 AND vol_ratio20 >= 1.2 THEN 1.0 ELSE 0.0 END",
            "pullback_contraction": "CASE WHEN ret_1 < 0 AND vol_ratio20 <= 0.8 THEN 1.0 ELSE 0.0 END",
        },
    ),
    "w09_quality_window": bars(
        [],
        BAD,
        {
            "bad_in_20": f"max(bad) {frame(20)}",
            "active_in_20": f"count(CASE WHEN volume > 0 THEN 1 END) {frame(20)}",
            "warm": f"CASE WHEN count(*) {frame(60)} = 60 THEN 1 ELSE 0 END",
        },
        plain=("bad_in_20", "active_in_20", "warm"),
    ),
    "w10_price_volume": bars(list(BAR_SHAPE), *RANGE_STAGES, BAR_SHAPE),
    "w12_range_duration": bars(
        [],
        *RANGE_STAGES,
        VALID_RANGE,
        {"broken": f"sum(1 - in_range) OVER ({BY_SYMBOL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {
            "duration": "CASE WHEN in_range = 1 THEN least(120, sum(in_range) OVER (PARTITION BY symbol, broken"
            " ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) ELSE 0 END"
        },
        plain=("duration",),
    ),
    "w13_raw_quality": bars(
        [],
        PREVIOUS,
        {
            "unit_price": "amount / nullif(volume, 0)",
            "action_gap": "CASE WHEN abs(open / nullif(prev_close, 0) - 1) > 0.5 THEN 1 ELSE 0 END",
        },
        {
            "unit_disagrees": "CASE WHEN unit_price > high * 1.01 OR unit_price < low * 0.99 THEN 1 ELSE 0 END",
            "gap_in_20": f"max(action_gap) {frame(20)}",
        },
        {
            "reasons": "concat_ws(',', CASE WHEN open <= 0 OR low <= 0 THEN 'price_not_positive' END, CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'range_inverted' END,"
            " CASE WHEN volume <= 0 THEN 'no_volume' END, CASE WHEN unit_disagrees = 1 THEN 'units_disagree' END, CASE WHEN action_gap = 1 THEN 'action_gap_suspected' END,"
            " CASE WHEN gap_in_20 = 1 AND action_gap = 0 THEN 'action_gap_in_window' END, CASE WHEN verified = 0 THEN 'unverified' END)"
        },
        plain=("unit_disagrees", "action_gap", "gap_in_20", "reasons"),
    ),
    "w15_overlays": bars(
        ["sma20", "upper", "lower", "direction"],
        {"sma20": full("avg", "close", 20), "sd20": full("stddev_pop", "close", 20)},
        {"upper": "sma20 + 2 * sd20", "lower": "sma20 - 2 * sd20", "direction": f"sign(sma20 - {prior('sma20')})"},
        digits=4,
    ),
    "w19_supplementary": bars(
        ["ret_10", "ret_60", "high_distance", "low_distance", "vol_std20", "body_mean5", "up_share20"],
        PREVIOUS,
        {
            "ret_10": f"{ratio('close', prior('close', 10))} - 1",
            "ret_60": f"{ratio('close', prior('close', 60))} - 1",
            "high_distance": f"close / ({full('max', 'high', 20)}) - 1",
            "low_distance": f"close / ({full('min', 'low', 20)}) - 1",
            "vol_std20": ratio(full("stddev_pop", "volume", 20), full("avg", "volume", 20)),
            "body": "(close - open) / nullif(open, 0)",
            "up": "CASE WHEN close > prev_close THEN 1.0 WHEN prev_close IS NULL THEN NULL ELSE 0.0 END",
        },
        {"body_mean5": full("avg", "body", 5), "up_share20": full("avg", "up", 20)},
    ),
    "w20_mean_amount": bars(["mean_amount20"], {"mean_amount20": full("avg", "amount", 20, 0, 5)}),
    "w23_direction_label": bars(
        ["forward"],
        BAD,
        {
            "forward": f"{ratio(later('close', 5), later('open', 1))} - 1",
            "path_bad": f"max(bad) {ahead(5)}",
            "path": f"count(*) {ahead(5)}",
        },
        {
            "label": "CASE WHEN path < 5 THEN NULL WHEN forward > 0.02 THEN 2 WHEN forward < -0.02 THEN 0 ELSE 1 END",
            "reason": "CASE WHEN path < 5 THEN 'immature' WHEN path_bad = 1 THEN 'unverified_path' ELSE 'ok' END",
        },
        plain=("label", "reason"),
    ),
    "w24_atr_label": bars(
        ["move", "band"],
        PREVIOUS,
        TRUE_RANGE,
        {"atr": full("avg", "true_range", 14), "ahead_close": later("close", 10)},
        {"move": "ln(1 + (ahead_close - close) / close)", "band": "ln(1 + atr / close)"},
        {"label": "CASE WHEN move > band THEN 'UP' WHEN move < -band THEN 'DOWN' WHEN move IS NOT NULL AND band IS NOT NULL THEN 'FLAT' END"},
        plain=("label",),
    ),
    "w25_observations": bars(
        ["ret_5", "vol_ratio", "target"],
        {
            "ret_5": RETURNS["ret_5"],
            "vol_ratio": ratio("volume", full("avg", "volume", 20, 1)),
            "target": f"{ratio(later('close', 5), 'close')} - 1",
        },
        {"klass": "CASE WHEN target > 0.03 THEN 2 WHEN target < -0.03 THEN 0 WHEN target IS NOT NULL THEN 1 END"},
        where="ret_5 IS NOT NULL AND vol_ratio IS NOT NULL AND klass IS NOT NULL",
        plain=("klass",),
    ),
    "w42_account_columns": bars(
        ["ma20", "atr14", "prev_close", "prev_high", "prev_low"],
        PREVIOUS,
        TRUE_RANGE,
        {
            "ma20": full("avg", "close", 20),
            "atr14": full("avg", "true_range", 14),
            "prev_high": prior("high"),
            "prev_low": prior("low"),
        },
    ),
    "w43_demand_supply": bars(["demand", "supply"], *RANGE_STAGES, BAR_SHAPE, *SCORE_STAGES),
    "w46_entry_plan": bars(
        ["stop", "distance", "weight"],
        *RANGE_STAGES,
        {"stop": "CASE WHEN low20 IS NOT NULL AND atr IS NOT NULL THEN greatest(low20, close - 2 * atr) END"},
        {"distance": "(close - stop) / close"},
        {
            "weight": "CASE WHEN distance > 0 THEN least(0.2, 0.01 / distance) END",
            "allowed": "CASE WHEN distance BETWEEN 0.01 AND 0.12 THEN 1 ELSE 0 END",
        },
        plain=("allowed",),
    ),
    "w47_risk_geometry": bars(
        ["floor_price", "distance", "cap"],
        *RANGE_STAGES,
        {"floor_price": "CASE WHEN low20 IS NOT NULL AND atr IS NOT NULL THEN greatest(low20, close - 3 * atr) END"},
        {"distance": "(close - floor_price) / close"},
        {
            "cap": "CASE WHEN distance > 0 THEN least(1.0, 0.02 / distance) END",
            "verdict": "CASE WHEN distance IS NULL THEN 'unavailable' WHEN distance <= 0 THEN 'below_floor'"
            " WHEN distance > 0.2 THEN 'too_far' ELSE 'ok' END",
        },
        plain=("verdict",),
    ),
    "w49_breakouts": bars(
        ["close", "high20", "relative_volume20", "demand", "supply"],
        *RANGE_STAGES,
        BAR_SHAPE,
        *SCORE_STAGES,
        where="close > high20 AND relative_volume20 >= 1.2 AND demand > supply",
    ),
    "p12_geometry": bars(
        [],
        {
            "priced": "CASE WHEN open > 0 AND high > 0 AND low > 0 AND close > 0 THEN 1 ELSE 0 END",
            "bounded": "CASE WHEN high >= greatest(open, close, low) AND low <= least(open, close, high) THEN 1 ELSE 0 END",
            "mismatch": "CASE WHEN (volume > 0) <> (amount > 0) THEN 1 ELSE 0 END",
            "suspended": "CASE WHEN volume = 0 AND amount = 0 THEN 1 ELSE 0 END",
        },
        plain=("priced", "bounded", "mismatch", "suspended"),
    ),
    "p19_price_plan": bars(
        ["atr_pct", "target_price", "price_low", "price_high"],
        PREVIOUS,
        TRUE_RANGE
        | AVERAGES
        | {"ret_1": RETURNS["ret_1"], "vol_ratio20": ratio("volume", full("avg", "volume", 20, 1))},
        {
            # Shares of the mean true range, and limits, of the plan's distances from the close.
            "atr_pct": f"coalesce(({full('avg', 'true_range', 20, 0, 2)}) / nullif(close, 0), 0.012)",
            "side": "CASE WHEN close < ma20 AND ret_1 < 0 AND vol_ratio20 >= 1.2 THEN 'SELL'"
            " WHEN close > ma20 AND ma5 > ma20 AND ret_1 > 0 AND vol_ratio20 >= 1.2 THEN 'BUY' ELSE '' END",
        },
        {"distance": "least(0.025, greatest(0.003, atr_pct * 0.35))"},
        {"far": "least(0.05, greatest(distance, atr_pct * 0.65))", "near": "least(0.025, greatest(0.0015, distance * 0.6))"},
        {
            "order_type": "CASE WHEN side = '' THEN '' WHEN side = 'SELL' AND close < 0.5 * ma20 THEN 'NEXT_DAY_MARKET' ELSE 'NEXT_DAY_LIMIT' END",
            "toward": "CASE side WHEN 'BUY' THEN -1 WHEN 'SELL' THEN 1 END",
        },
        {
            "target_price": "CASE WHEN order_type = 'NEXT_DAY_MARKET' THEN close ELSE close * (1 + toward * distance) END",
            "price_low": "CASE WHEN order_type = 'NEXT_DAY_MARKET' THEN close WHEN side = 'BUY' THEN close * (1 - far) WHEN side = 'SELL' THEN close * (1 + near) END",
            "price_high": "CASE WHEN order_type = 'NEXT_DAY_MARKET' THEN close WHEN side = 'BUY' THEN close * (1 - near) WHEN side = 'SELL' THEN close * (1 + far) END",
        },
        plain=("side", "order_type"),
    ),
    "p20_limit_fill": bars(
        ["limit_price", "fill_price"],
        {"limit_price": f"round({prior('close')} * 1.001, 2)"},
        {"fill_price": "CASE WHEN low <= limit_price THEN least(open, limit_price) END"},
    ),
    "p24_trade_guard": bars(
        ["band_low", "band_high"],
        PREVIOUS,
        {
            "seasoned": f"CASE WHEN count(*) {frame(60, 1)} >= 20 THEN 1 ELSE 0 END",
            "band_low": "round(prev_close * 0.9 + 1e-7, 2)",
            "band_high": "round(prev_close * 1.1 + 1e-7, 2)",
        },
        {
            "guard": "CASE WHEN prev_close IS NULL THEN 'no_previous' WHEN seasoned = 0 THEN 'unseasoned'"
            " WHEN volume = 0 THEN 'suspended' WHEN open >= band_high THEN 'at_upper_band'"
            " WHEN open <= band_low THEN 'at_lower_band' ELSE 'ok' END"
        },
        plain=("guard",),
    ),
    "p28_rule_signals": bars(
        [],
        AVERAGES | {"ret_1": RETURNS["ret_1"], "vol_ratio20": ratio("volume", full("avg", "volume", 20, 1))},
        {
            "rule_buy": "CASE WHEN close > ma20 AND ma5 > ma20 AND ret_1 > 0 AND vol_ratio20 >= 1.2 THEN 1 ELSE 0 END",
            "rule_sell": "CASE WHEN close < ma20 AND ret_1 < 0 AND vol_ratio20 >= 1.2 THEN 1 ELSE 0 END",
        },
        plain=("rule_buy", "rule_sell"),
    ),
    "k01_last_bars": bars(
        ["close"], {"back": "row_number() OVER (PARTITION BY symbol ORDER BY date DESC)"}, where="back <= 30", plain=("back",)
    ),
    "a12_amount_change": bars(
        ["change", "change_ratio"],
        {"before": prior("amount")},
        {"change": "amount - before", "change_ratio": "amount / nullif(before, 0) - 1"},
    ),
}
