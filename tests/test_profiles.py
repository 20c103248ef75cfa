"""Profiles at every bar against windows of collected bars."""

from marketgrid.plans import registry
from marketgrid.sources.tables import bars_daily

SF = "/root/testdata/sf0.001"


def test_profiles_of_every_bar(spark):
    bars = {}
    for r in sorted(bars_daily(spark, SF).collect(), key=lambda r: r.date):
        bars.setdefault(r.symbol, []).append(((r.high + r.low + r.close) / 3, r.volume, r.date))
    ends = {(s, b[k][2]): b[k - 119 : k + 1] for s, b in bars.items() for k in range(119, len(b))}
    got = {(r.symbol, r.as_of): r for r in registry.QUERIES["w16_weighted_quantiles"](spark, SF).collect()}
    assert ends and set(got) == set(ends)
    for key, window in ends.items():
        total, c, mid = sum(x[1] for x in window), 0, None
        for price, volume, _ in sorted(window):
            c += volume
            if mid is None and c >= total / 2:
                mid = price
        assert abs(got[key].mid - mid) < 1e-5
    volume = {}
    for r in registry.QUERIES["w17_histogram_all"](spark, SF).collect():
        volume.setdefault((r.symbol, r.as_of), []).append(r.volume)
    assert set(volume) == set(ends)
    assert all(len(v) == 32 and abs(sum(v) - sum(x[1] for x in ends[k])) < 1 for k, v in volume.items())
