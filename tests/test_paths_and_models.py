"""Target path, bootstraps, fitted models and CSV bars against plain versions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgrid.operators import accounts, models, more, targets
from marketgrid.plans import registry

SF = "/root/testdata/sf0.001"


def follow(spark, *bars, policy=targets.Policy()):
    """Path over bars of (up, down, cap, stop, close[, passed])."""
    rows = [(1, datetime.date(2024, 1, 1) + datetime.timedelta(k), *(b if len(b) == 6 else (*b, True))) for k, b in enumerate(bars)]
    frame = spark.createDataFrame(rows, "symbol long, date date, up double, down double, cap double, stop double, close double, passed boolean")
    return [(r.target, r.stop, r.why) for r in targets.target_path(targets.asked(frame, policy), policy).orderBy("date").collect()]


def test_target_path_rules(spark):
    policy = targets.Policy()
    full = (0.6, 0.2, 0.2, 9.0, 10.0)  # edge 0.4: the whole cap
    edge = lambda wanted: policy.edge_entry + wanted / 0.2 * (policy.edge_full - policy.edge_entry)
    cases = [
        ((full,), (0.2, 9.0, "moved")),
        ((full, (0.41, 0.4, 0.2, 9.5, 10.0)), (0.2, 9.5, "wait")),  # the wait band holds, the stop rises
        ((full, (0.41, 0.4, 0.2, 9.5, 10.0), (0.6, 0.2, 0.2, 9.0, 10.0)), (0.2, 9.5, "hold")),  # and never falls
        ((full, (edge(0.17), 0.0, 0.2, None, 10.0)), (0.2, 9.0, "hold")),  # half a step and the hysteresis: 0.17 holds
        ((full, (edge(0.16), 0.0, 0.2, None, 10.0)), (0.15, 9.0, "moved")),  # 0.16 moves
        ((full, (0.41, 0.4, 0.12, 8.0, 10.0)), (0.1, 9.0, "cap")),  # a lower cap, in whole steps
        ((full, (None, None, None, None, 9.5)), (0.2, 9.0, "stale")),
        ((full, (None, None, None, None, 8.9)), (0.0, None, "stop")),
        ((full, (0.6, 0.2, 0.2, 9.0, 8.9)), (0.0, None, "stop")),
        ((full, (0.1, 0.6, 0.2, 9.0, 10.0)), (0.0, None, "moved")),
        ((full, (0.1, 0.6, 0.2, 9.8, 10.0, False)), (0.2, 9.0, "gate")),  # no gate: nothing bearish, the stop stays
        ((full, (0.6, 0.2, 0.1, 9.8, 10.0, False)), (0.1, 9.0, "cap")),  # only the risk cap reduces
        (((0.6, 0.2, 0.2, 9.0, 10.0, False),), (0.0, None, "gate")),
        ((full, (0.6, 0.2, 0.2, 9.0, 8.0, False)), (0.0, None, "stop")),
        (((0.6, 0.2, 0.2, None, 10.0),), (0.2, None, "moved")),
    ]
    for bars, want in cases:
        assert follow(spark, *bars)[-1] == want, bars


def test_gate_looks_only_at_known_closes(spark):
    closes = [10.0 + (k % 7) * (-1) ** (k % 3) for k in range(90)]
    ups = [0.6 if k % 2 else 0.2 for k in range(90)]
    rows = [(1, datetime.date(2024, 1, 1) + datetime.timedelta(k), c, u, 0.4) for k, (c, u) in enumerate(zip(closes, ups))]
    made = lambda of: [r.passed for r in targets.gate(spark.createDataFrame(of, "symbol long, date date, close double, up double, down double")).orderBy("date").collect()]
    got = made(rows)  # as many bars as the gate looks back at most
    for k in range(90):
        hits = [np.sign(ups[j] - 0.4) == np.sign(closes[j + 1] - closes[j]) for j in range(k)]
        assert bool(got[k]) == (len(hits) >= 20 and sum(hits) >= 0.5 * len(hits))
    assert made(rows[:50]) == got[:50]


def test_target_path_table(spark):
    rows = targets.w50_target_path(spark, SF).collect()
    bars = registry.QUERIES["w47_risk_geometry"](spark, SF).count()
    assert len(rows) == bars and all(0 <= r.target <= 0.2 and math.isclose(r.target / 0.05, round(r.target / 0.05), abs_tol=1e-6) for r in rows)
    assert all((r.target == 0) <= (r.stop is None) for r in rows) and {"moved", "wait", "stop", "gate"} <= {r.why for r in rows}


def test_paired_bootstrap_equals_numpy(spark):
    legs = more._legs(spark, SF).filter("abs(a) < 0.5 AND abs(b) < 0.5")
    days = sorted(legs.collect(), key=lambda r: r.date)
    a, b = (np.array([r[x] for r in days]) for x in "ab")
    block, seed, draws = 20, 5, 12
    spots = spark.range(draws).crossJoin(spark.range(-(-len(a) // block)).withColumnRenamed("id", "k"))
    starts = {(r.id, r.k): r.s for r in spots.select("id", "k", F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.lit(len(a) - block + 1)).alias("s")).collect()}
    sharpe = lambda x: math.sqrt(252) * x.mean() / x.std(ddof=1)
    got = {r.draw: r for r in more.paired_draws(legs, draws, block, seed).collect()}
    assert len(got) == draws
    for d in range(draws):
        at = np.concatenate([starts[d, k] + np.arange(block) for k in range(-(-len(a) // block))])[: len(a)]
        assert math.isclose(got[d].cumulative, np.prod(1 + a[at]) - np.prod(1 + b[at]), rel_tol=1e-6)
        assert math.isclose(got[d].sharpe, sharpe(a[at]) - sharpe(b[at]), rel_tol=1e-6, abs_tol=1e-9)
    assert more.paired_draws(legs.limit(40), draws, block, seed).count() == 0  # fewer than 60 sessions


def test_block_bootstrap_equals_numpy(spark):
    means = accounts.a31_block_means(spark, SF).collect()
    got = {r.block: r for r in accounts.a31_bootstrap(spark, SF, reps=40).collect()}
    assert set(got) == {5, 20}
    for block, r in got.items():
        known = {m.session: m[f"block_{block}"] for m in means if m[f"block_{block}"] is not None}
        frame = accounts.a31_block_means(spark, SF).filter(f"block_{block} IS NOT NULL")
        drawn = {}
        for s in accounts.a31_starts(spark, frame, 40, block, 11).collect():
            drawn.setdefault(s.rep, []).append(known[s.session])
        values = [np.mean(x) for x in drawn.values()]
        assert [round(float(np.quantile(values, q)), 5) for q in (0.025, 0.5, 0.975)] == [round(x, 5) for x in (r.low, r.mid, r.high)]


@pytest.fixture(scope="module")
def samples(spark):
    return models.samples(spark, SF).collect()


def test_logistic_is_the_best_of_its_strengths(spark, samples):
    rows = models.m02_logistic(spark, SF).collect()
    held = {(r.symbol, r.date): int(r.label) for r in samples if not r.train}
    assert {(r.symbol, r.date) for r in rows} == set(held)
    assert all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-5 for r in rows)
    loss = -np.mean([math.log(max((r.p0, r.p1, r.p2)[held[r.symbol, r.date]], 1e-12)) for r in rows])
    assert loss < math.log(3)  # better than knowing nothing


def test_temperature_is_the_least_loss_of_a_grid(spark):
    r = models.m03_temperature(spark, SF).first()
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=models.FEATURES, outputCol="features").transform(models.samples(spark, SF))
    model = LogisticRegression(family="multinomial", maxIter=30).fit(rows.filter("train"))
    p = [(x.p, int(x.label)) for x in models._probabilities(model, rows.filter("NOT train")).collect()]

    def loss(t):
        return float(np.mean([-math.log(max(q[k], 1e-12) ** (1 / t) / sum(max(x, 1e-12) ** (1 / t) for x in q)) for q, k in p]))

    assert r.n == len(p) and abs(loss(r.temperature) - r.log_loss) < 1e-4
    assert all(r.log_loss <= loss(t) + 1e-5 for t in np.exp(np.linspace(math.log(0.2), math.log(5), 25)))


def test_platt_equals_newton(spark, samples):
    r = models.m04_platt(spark, SF).first()
    s, y = np.array([x.ret_5 for x in samples]), np.array([float(x.label == 2) for x in samples])
    x, w = np.stack([s, np.ones(len(s))], 1), np.zeros(2)
    for _ in range(8):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert r.n == len(s) and abs(r.slope - w[0]) < 1e-3 and abs(r.intercept - w[1]) < 1e-3


def test_perceptron_counts_every_held_out_row(spark, samples):
    rows = models.m06_mlp(spark, SF).collect()
    assert sum(r.n for r in rows) == sum(not x.train for x in samples)
    held = [x.label for x in samples if not x.train]
    right = sum(r.n for r in rows if r.label == r.prediction)
    assert right >= 0.8 * max(held.count(k) for k in (0.0, 1.0, 2.0))  # near or better than always the commonest class


def test_average_cost_of_a_ledger():
    import pandas as pd

    rows = [(1, 1, 1, "BUY", 1000.0, 10), (1, 2, 2, "BUY", 2000.0, 10), (1, 3, 3, "SELL", 900.0, 5), (1, 4, 4, "SELL", 4000.0, 20), (1, 5, 5, "BUY", 50.0, 1)]
    fills = pd.DataFrame(rows, columns=["account", "fill_id", "date", "side", "notional", "shares"])
    got = accounts.ledger_rows(fills.sample(frac=1, random_state=1))
    assert got.held.tolist() == [10, 20, 15, 0, 1] and got.realised.tolist() == [0, 0, 150, 900, 900]
    assert got.average_cost.fillna(-1).tolist() == [100, 150, 150, -1, 50] and got.marked.tolist() == [0, 1000, 600, 900, 900]


def test_average_cost_goes_on_over_batches():
    import pyarrow as pa

    rows = [(a, 10 * a + k, "BUY" if k % 3 else "SELL", 100.0 * (k + a), k + 1) for a in range(3) for k in range(7)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(accounts.FILL, r, strict=True)) for r in rows[k : k + 4]]) for k in range(0, len(rows), 4)]
    kinds = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.float64()) for x in accounts.LEDGER.split(", ")])
    got = [tuple(r.values()) for b in accounts.ledger_batches(iter(batches), kinds) for r in b.to_pylist()]
    assert got == [x for a in range(3) for x in accounts.ledger_steps(r for r in rows if r[0] == a)]


def test_a_registered_average_cost_has_no_grouped_frame(spark):
    frame = accounts.a27_average_cost(spark, SF)
    assert "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString() and frame.count() == accounts.fills(spark, SF).count()


def test_csv_bars_by_file_name_and_alias(spark, tmp_path):
    from marketgrid.sources.stores import read_csv_bars

    (tmp_path / "600519.csv").write_text("trade_date,close_price,vol\n2024-01-02,10.5,100\nbad,x,\n")
    (tmp_path / "000001.csv").write_text("trade_date,close_price,vol\n2024-01-03,7,5\n")
    rows = {(r.symbol, str(r.date)): (r.close, r.volume) for r in read_csv_bars(spark, f"file://{tmp_path}").collect()}
    assert rows == {("600519", "2024-01-02"): (10.5, 100.0), ("600519", "None"): (None, None), ("000001", "2024-01-03"): (7.0, 5.0)}


def test_csv_bars_have_a_file_for_each_symbol(spark, tmp_path, monkeypatch):
    from marketgrid.sources import stores

    monkeypatch.setattr(stores, "shared", lambda _: f"file://{tmp_path}/bars")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks write
    try:
        n = stores.s05_csv_bars(spark, SF).select("symbol").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("bars/*/*.csv"))) == len(list(tmp_path.glob("bars/symbol=*"))) == n


def test_csv_bars_go_through_in_parts_of_symbols(spark, tmp_path, monkeypatch):
    from marketgrid.sources import stores, tables

    monkeypatch.setattr(stores, "shared", lambda _: f"file://{tmp_path}/bars")
    monkeypatch.setattr(stores, "FILES", 3, raising=False)
    got = stores.s05_csv_bars(spark, SF)
    want = tables.bars_daily(spark, SF).select("symbol", "date", "close")
    assert not [x for x in got.inputFiles() if x.endswith(".csv")]  # the plan, which the driver holds, names no symbol's file
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    n = want.select("symbol").distinct().count()
    assert n > 3 and len(list(tmp_path.glob("bars/*/*.csv"))) == len(list(tmp_path.glob("bars/symbol=*"))) == n


def test_late_rows_of_the_second_part_go_aside(spark):
    from marketgrid.streaming import jobs

    rows = jobs.t04_late_evidence(spark, SF).collect()
    assert {r.target for r in rows} == {"main", "side"} and all(r.target == "main" for r in rows if r.event_id % 2 == 0)


def test_samples_are_made_once(spark):
    """What is counted and scored after a fit is read from what the fit read, not made again from the lines."""
    from marketgrid.operators import scoring

    assert models.m03_temperature(spark, SF).inputFiles() == []
    scored = scoring.m05_model_scores(spark, SF)
    assert scored.inputFiles() and not any("lineitem" in name for name in scored.inputFiles())
    assert scored.count() == scoring.features(spark, SF).count()


def test_platt_counts_in_its_sums(spark):
    assert models.m04_platt(spark, SF).inputFiles() == []


def test_losses_of_many_temperatures_are_one_aggregate(spark):
    """Rows of a class that was not fitted are left out, as before; impossible ones count as 1e-12."""
    rows = spark.createDataFrame([(0.0, [0.2, 0.8]), (1.0, [0.5, 0.5]), (0.0, [0.0, 1.0]), (2.0, [0.9, 0.1])], "label double, p array<double>")
    for t, got in zip((0.5, 1.0, 3.0), models.log_losses(models.log_ratios(rows, 2), (0.5, 1.0, 3.0)), strict=True):
        own = [max(p[k], 1e-12) ** (1 / t) / sum(max(x, 1e-12) ** (1 / t) for x in p) for k, p in ((0, [0.2, 0.8]), (1, [0.5, 0.5]), (0, [0.0, 1.0]))]
        assert abs(got + np.mean(np.log(own))) < 1e-9
