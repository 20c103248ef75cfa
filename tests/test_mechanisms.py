"""Interval joins, adjusted prices, first breaks, sliding profiles and bitemporal winners against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgrid.operators import accounts, actions, evidence, sliding

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


def test_interval_join_equals_product(spark):
    rng = random.Random(1)
    points = [(k % 3, k, day(rng.randrange(400))) for k in range(120)]
    spans = [(k % 3, k, day(a), day(a + rng.choice([-2, 0, 1, 5, 40, 300]))) for k, a in ((k, rng.randrange(300)) for k in range(40))]
    got = actions.interval_join(spark.createDataFrame(points, "key int, p int, at date"), spark.createDataFrame(spans, "key int, s int, low date, high date"), ["key"], "at", "low", "high")
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for k, p, at in points for key, s, low, high in spans if k == key and low < at <= high)


def rescaled(bars, by_day, n, m):
    """Day by day: what was seen before is rescaled at each action, then averaged."""
    closes, ranges, before, ma, out = [], [], None, None, []
    for d, high, low, close in bars:
        ratio = by_day.get(d, 1.0) if before is not None else 1.0
        closes, ranges = [c * ratio for c in closes], [r * ratio for r in ranges]
        before, ma = (x * ratio if x is not None else None for x in (before, ma))
        ranges.append(high - low if before is None else max(high - low, abs(high - before), abs(low - before)))
        closes.append(close)
        last_ma, ma = ma, sum(closes[-n:]) / n if len(closes) >= n else None
        out.append((before, ma, last_ma, sum(ranges[-m:]) / m if len(ranges) >= m else None))
        before = close
    return out


def test_adjusted_indicators_equal_rescaling_day_by_day(spark):
    rng, rows = random.Random(2), []
    for k in range(60):
        low = rng.uniform(5, 6)
        rows.append((1, day(k * 2), low + 0.2, low + 1, low, rng.uniform(low, low + 1), 100.0 + k, 1000.0))
    bars = spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double, amount double")
    terms = "action_id long, symbol long, ex_date date, cash double, multiplier double, price_factor double"
    declared = [(1, 1, day(21), 0.5, 1.0, None), (2, 1, day(50), 0.0, 2.0, None), (3, 1, day(50), 0.2, 1.0, None), (4, 1, day(90), 9.0, 1.0, None), (5, 1, day(100), 0.0, 1.0, 0.8), (6, 1, DAY, 0.0, 2.0, None), (7, 1, day(500), 0.0, 2.0, None)]
    got = actions.adjusted(bars, actions.factors(bars, spark.createDataFrame(declared, terms))).orderBy("date").collect()
    close = {r[1]: r[5] for r in rows}
    by_day = {day(22): (close[day(20)] - 0.5) / close[day(20)], day(50): 0.5 * (close[day(48)] - 0.2) / close[day(48)], day(100): 0.8}  # action 4 isn't covered
    same = lambda x, y: (x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=6e-4))
    for r, want in zip(got, rescaled([(x[1], x[3], x[4], x[5]) for x in rows], by_day, 20, 14), strict=True):
        assert all(map(same, (r.close_before, r.ma, r.ma_before, r.atr), want)), r.date
    after = lambda d: math.prod(f for on, f in by_day.items() if on > d)
    assert all(same(r.adj_close, close[r.date] * after(r.date)) and same(r.adj_volume, (100 + k) * (2 if r.date < day(50) else 1)) for k, r in enumerate(got))


def test_terms_are_refused_with_reasons(spark):
    base = dict(action_id=1, symbol=1, source_id="x", record_date=day(5), ex_date=day(6), available=day(5), cash=1.0, multiplier=1.0, tax=0.1, pay_date=day(6), price_factor=None, tie=0.0)
    cases = [({}, ""), ({"source_id": None}, "no_source"), ({"ex_date": day(5)}, "record_not_before_ex"), ({"available": day(6)}, "terms_known_late"), ({"cash": -1.0}, "negative_terms"), ({"multiplier": 0.5}, "negative_terms"), ({"tax": 2.0}, "bad_tax"), ({"pay_date": day(5)}, "pays_before_ex"), ({"multiplier": 2.0, "ex_date": day(8), "pay_date": day(8)}, "detached_rights"), ({"multiplier": 2.0}, ""), ({"price_factor": 0.0}, "bad_factor")]
    rows = [tuple((base | change | {"action_id": k}).values()) for k, (change, _) in enumerate(cases)] + [tuple((base | {"tie": 1.0, "action_id": 0}).values())]
    schema = "action_id int, symbol int, source_id string, record_date date, ex_date date, available date, cash double, multiplier double, tax double, pay_date date, price_factor double, tie double"
    sessions = spark.createDataFrame([(day(k),) for k in range(20)], "date date")
    got = {(r.action_id, r.n): ",".join(r.reasons) for r in actions.normalised(spark.createDataFrame(rows, schema), sessions).withColumn("n", F.size("reasons")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k, len(want.split(",")) if want else 0] == want
    assert got[0, 1] == "repeated_id"


@pytest.mark.parametrize("touch", [False, True])
def test_first_breaks_equal_search(touch):
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 300):
        closes = [float(rng.randrange(20)) for _ in range(n)]
        levels = [rng.choice([None, float("nan"), float(rng.randrange(20))]) for _ in range(n)]
        under = lambda c, x: c <= x if touch else c < x
        want = [next((j for j in range(k + 1, n) if x is not None and under(closes[j], x)), None) for k, x in enumerate(levels)]
        assert sliding.first_breaks(closes, levels, touch) == want


@pytest.mark.parametrize("window", [1, 5, 120])
def test_sliding_profiles_equal_fresh_ones(window):
    rng = np.random.default_rng(window)
    prices, weights = rng.integers(1, 40, 400) / 7, rng.integers(0, 5, 400)
    weights[100:100 + window + 20] = 0
    got = {k: (ordered, held.total, [held.at(q) for q in (0.15, 0.5, 0.85, 1.0)], *accounts._bins(ordered, held, 32)) for k, ordered, held in sliding.profiles(prices, weights, window)}
    for k in range(window - 1, 400):
        p, w = prices[k - window + 1 : k + 1], weights[k - window + 1 : k + 1]
        p, w = p[w > 0], w[w > 0]
        assert (k in got) == bool(len(p))
        if len(p):
            order = np.argsort(p, kind="stable")
            sums = np.cumsum(w[order])
            ordered, total, places, low, high, volume = got[k]
            assert total == sums[-1] and [ordered[x] for x in places] == [p[order][np.searchsorted(sums, sums[-1] * q)] for q in (0.15, 0.5, 0.85, 1.0)]
            half = max(abs(p.min()) * 0.005, 0.005) if p.min() == p.max() else 0.0
            assert (low, high) == (p.min() - half, p.max() + half)
            at = np.minimum(np.floor((p - low) / (high - low) * 32), 31).astype(int)
            assert np.array_equal(volume, np.bincount(at, w, 32) / accounts.SHARE_PARTS)


@pytest.mark.parametrize("window", [1, 5, 120])
def test_blocks_of_windows_equal_the_sliding_ones(window):
    rng = np.random.default_rng(window)
    prices, weights = rng.integers(1, 40, 400) / 7, rng.integers(0, 5, 400)
    weights[100:100 + window + 20] = 0
    want = {k: ([ordered[held.at(q)] for q in (0.15, 0.5, 0.85)], *accounts._bins(ordered, held, 32)) for k, ordered, held in sliding.profiles(prices, weights, window)}
    got = {k: list(x) for at, own in sliding.block_quantiles(prices, weights, window, (0.15, 0.5, 0.85)) for k, *x in zip(at.tolist(), *own, strict=True)}
    assert got == {k: x[0] for k, x in want.items()}
    seen = set()
    for at, low, high, volume in sliding.block_histograms(prices, weights, window, 32):
        assert len(at) <= sliding.BLOCK
        for k, a, b, v in zip(at.tolist(), low, high, volume, strict=True):
            seen.add(k)
            assert (a, b) == want[k][1:3] and np.array_equal(v / accounts.SHARE_PARTS, want[k][3])
    assert seen == set(want)
    assert sliding.whole_weights(np.array([1.25, np.nan, -3.0]), 100).tolist() == [125, 0, 0]


def test_newest_as_of_where_late_rows_do_not_win(spark):
    rows = [("a", 1, day(3), day(9)), ("a", 2, day(5), day(5)), ("a", 3, day(4), day(20)), ("b", 4, day(1), day(1))]
    asked = [("a", day(k)) for k in (4, 5, 9, 20)] + [("b", day(0)), ("b", day(1)), ("c", day(9))]
    found = evidence.newest_as_of(spark.createDataFrame(rows, "board string, id int, ranked date, seen date"), spark.createDataFrame(asked, "board string, cutoff date"), "board", F.col("seen"), ["ranked", "id"], "cutoff")
    assert {(r.board, r.cutoff): r.id for r in found.collect()} == {("a", day(4)): None, ("a", day(5)): 2, ("a", day(9)): 2, ("a", day(20)): 2, ("b", day(0)): None, ("b", day(1)): 4, ("c", day(9)): None}


def test_alive_until_break_both_sides(spark):
    closes = [10.0, 12.0, 13.0, 11.0, 9.0, 8.0, 10.0]
    level = {1: ("BUY", 11.5), 4: ("SELL", 9.5), 6: ("BUY", 9.0)}
    rows = [(1, day(k), c, level.get(k, (None, None))[1], level.get(k, (None, None))[0]) for k, c in enumerate(closes)]
    frame = spark.createDataFrame(rows, "symbol long, date date, close double, level double, side string")
    assert {r.date: (r.alive, r.broken_on) for r in evidence.alive_until_break(frame, 100).collect()} == {day(1): (1, day(3)), day(4): (1, day(6)), day(6): (0, None)}
    assert {r.date: (r.alive, r.broken_on) for r in evidence.alive_until_break(frame, 1).collect()}[day(1)] == (1, None)


def test_fifo_of_one_large_account_is_linear(spark):
    """40,000 fills of one account (a pass that looked ahead from each fill took most of a minute)."""
    import time

    rows = spark.range(40_000).selectExpr("1L AS account", "id AS fill_id", "CAST('2020-01-01' AS date) AS date", "CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side", "1.0D AS notional", "id % 7 + 1 AS shares")
    kept = accounts.fills
    accounts.fills = lambda *_: rows
    try:
        began = time.perf_counter()
        assert accounts.a28_fifo(spark, "").agg(F.sum("shares")).first()[0] == min(sum(k % 7 + 1 for k in range(0, 40_000, 2)), sum(k % 7 + 1 for k in range(1, 40_000, 2)))
        assert time.perf_counter() - began < 20
    finally:
        accounts.fills = kept


def test_ranks_by_range_equal_ranks_in_one_order(spark):
    from marketgrid.operators import tables

    rng = np.random.default_rng(9)
    scores, labels = np.round(rng.normal(size=3000), 2), rng.integers(0, 2, 3000)
    got = tables.auc(spark.createDataFrame(list(zip(scores.tolist(), labels.tolist())), "s double, y int"), "s", "y").first()
    pairs = scores[labels == 1][:, None] - scores[labels == 0][None, :]
    assert (got.n, got.p) == (3000, labels.sum()) and math.isclose(got.auc, ((pairs > 0) + 0.5 * (pairs == 0)).mean(), rel_tol=1e-12)
    assert tables.auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first().auc is None


def test_fingerprint_is_updated_by_its_days(spark):
    from marketgrid.operators import tables
    from marketgrid.sources.tables import bars_daily

    bars = bars_daily(spark, "/root/testdata/sf0.001")
    dates = spark.createDataFrame([(dt.date(1996, 3, 4),), (dt.date(1997, 8, 9),)], "date date")
    changed = bars.join(dates, "date", "left_semi").withColumn("close", F.col("close") + 1).select(bars.columns)
    whole = bars.join(dates, "date", "left_anti").select(bars.columns).unionByName(changed)
    first, full = (sorted(tables.fingerprint(tables.day_digests(x)).collect()) for x in (bars, whole))
    assert sorted(tables.fingerprint(tables.refreshed(tables.day_digests(bars), changed, dates)).collect()) == full
    assert {r.part for r in first} - {r.part for r in set(first) & set(full)} == {"1996-03", "1997-08", "*"}


def test_episodes_by_hand(spark):
    from marketgrid.operators import episodes

    rows = [(1, 1, day(0), "BUY", 10_000.0, 1000), (1, 2, day(5), "SELL", 12_000.0, 1000), (1, 3, day(6), "BUY", 5_000.0, 500), (1, 4, day(7), "SELL", 2_000.0, 200), (2, 5, day(1), "BUY", 10.0, 1), (2, 6, day(2), "SELL", 11.0, 1), (3, 7, day(1), "BUY", 20_000.0, 1000), (3, 8, day(2), "SELL", 20_150.0, 1000)]
    fills = spark.createDataFrame(rows, "account long, fill_id long, date date, side string, notional double, shares long")
    matches = spark.createDataFrame([(2, 1, 1000), (4, 3, 200), (6, 5, 1), (8, 7, 1000)], "sell long, buy long, shares long")
    got = {r.buy: r for r in episodes.episodes(fills, matches).collect()}
    paid, received = 10_005.0, 12_000 - 5.0 - 6.0  # least commission on both sides, tax on the sale
    stopped = 1000 * 9.18  # 10 less 8 % and slippage, to the tick
    risk = paid - (stopped - 5.0 - stopped * 0.0005)
    assert (got[1].klass, got[1].open_shares, got[1].exit_date) == ("high", 0, day(5)) and math.isclose(got[1].net_return, received / paid - 1, abs_tol=1e-6)
    assert math.isclose(got[1].risk_cash, risk, abs_tol=1e-3) and math.isclose(got[1].r_multiple, (received - paid) / risk, abs_tol=1e-4)
    assert (got[3].klass, got[3].open_shares, got[3].net_return, got[3].exit_date) == ("open", 300, None, None)
    assert (got[5].klass, got[5].r_multiple) == ("no_risk", None)  # fees are most of it
    assert (got[7].klass, got[7].low_return) == ("ordinary", True)


def test_model_is_kept_by_version_and_guards_its_training_days(spark):
    from marketgrid.operators import models, scoring
    from marketgrid.sources.stores import shared

    sf, at = "/root/testdata/sf0.01", shared(spark)
    rows = models.samples(spark, sf)
    one = scoring.fit(rows, "a", dt.date(1998, 1, 1))
    other = scoring.Model("b", dt.date(1999, 1, 1), 2.0, {k: {f: k + 1.0 for f in (*models.FEATURES, "")} for k in range(3)})
    assert scoring.save(spark, one, at) and scoring.save(spark, other, at) and not scoring.save(spark, other, at)
    assert scoring.load(spark, at, "a") == one and scoring.load(spark, at) == other
    with pytest.raises(LookupError):
        scoring.load(spark, at, "c")
    inputs = scoring.features(spark, sf).filter("symbol < 3")
    for r in scoring.score(inputs, one).collect():
        x = [r[f] for f in models.FEATURES]
        want = "in_training" if r.date <= one.trained_until else "missing" if None in x else "scored"
        assert r.status == want and (r.score is None) == (want != "scored")
        if want == "scored":
            z = np.array([sum(one.weights[k][f] * v for f, v in zip(models.FEATURES, x)) + one.weights[k][""] for k in range(3)]) / one.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert np.allclose([r.p0, r.p1, r.p2], p, atol=1e-6) and math.isclose(r.score, 100 * (p[2] + p[1] / 2), abs_tol=1e-3)
    # Later bars don't change what training by an earlier day gives.
    assert scoring.fit(rows.filter("date < '1998-06-01'"), "a", dt.date(1998, 1, 1)) == one


def test_range_columns_equal_their_windows(spark):
    """The kernel gives what the stages' SQL gives, bit for bit, also where values are missing and symbols are short; it adds no window."""
    from marketgrid.operators import trailing

    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.03 else x
    rows = [(s, day(k), *(maybe(round(rng.uniform(9, 12), 3)) for _ in range(3)), maybe(float(rng.randrange(4))), maybe(rng.uniform(0, 9))) for s, n in ((1, 200), (2, 3), (3, 61)) for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol long, date date, high double, low double, close double, volume double, amount double")
    want = bars
    for stage in trailing.RANGE_STAGES:
        want = want.selectExpr("*", *(f"{e} AS {name}" for name, e in stage.items()))
    want = want.selectExpr("*", f"CAST(count(high) {trailing.frame(60, 1)} AS int) AS range_count")
    got = trailing.ranged(bars)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_window_medians():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 50, 90) / 4
    x[rng.random(90) < 0.1] = np.nan
    x[40:65] = np.nan
    for n in (1, 4, 5, 20):
        want = [np.nan if k < n - 1 or np.isnan(x[k - n + 1 : k + 1]).all() else np.nanmedian(x[k - n + 1 : k + 1]) for k in range(90)]
        assert np.array_equal(accounts.window_medians(x, n), want, equal_nan=True)


def test_bars_of_symbols_with_the_same_boards_are_summed_before_they_multiply(spark):
    """Metrics equal those of bars repeated for each board; symbols 1, 2 and 3 are one class."""
    from marketgrid.operators import boards

    of = {1: "AB", 2: "BA", 3: "AB", 4: "B", 5: "BB"}
    membership = spark.createDataFrame([("concept", s, b) for s, bs in of.items() for b in bs] + [("industry", 4, None)], "kind string, symbol long, board string")
    alike, named = boards._alike(membership)
    assert alike.select("class").distinct().count() == 3 and named.count() == 2 + 2 + 2
    bars = [(s, d, None if (s + d) % 4 == 0 else s - 2.5 + d, float(s), 3.0 if s != 2 else None, 2.5 if s < 5 else None, None if s == 3 else 10.0 * s + d) for s in range(1, 7) for d in range(3)]
    got = boards.board_daily(spark.createDataFrame(bars, "symbol long, date int, ret_1 double, close double, ma20 double, high20 double, amount double"), membership).collect()
    want = {}
    for bar in bars:
        for kind, board in [("concept", b) for b in of.get(bar[0], "")] + [("industry", None)] * (bar[0] == 4):
            want.setdefault((kind, board, bar[1]), []).append(bar)
    mean = lambda xs, n: sum(xs) / len(xs) if n >= boards.MIN_MEMBERS and xs else None
    assert {(r.kind, r.board, r.date) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        rows = want[r.kind, r.board, r.date]
        known = [x[2] for x in rows if x[2] is not None]
        assert (r.n_members, r.n_known) == (len(rows), len(known))
        assert r.mean_return == pytest.approx(mean(known, len(known))) and r.advance_ratio == mean([x > 0 for x in known], len(known))
        for k, value in ((4, r.above_ma20), (5, r.breakout)):
            over = [x[3] > x[k] for x in rows if x[k] is not None]
            assert value == mean(over, len(over))
        amounts = [x[6] for x in rows if x[6] is not None]
        assert r.amount == (sum(amounts) if amounts else None)
