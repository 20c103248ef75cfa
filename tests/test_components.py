"""Components over all lines against union-find."""

from marketgrid.plans import registry

SF = "/root/testdata/sf0.001"


def test_components_of_all_lines(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    for r in lines:
        a, b = find(r.l_suppkey * 2), find(r.l_partkey * 2 + 1)
        root[max(a, b)] = min(a, b)
    label = {x: find(x) for x in root}
    size = {}
    for x in label.values():
        size[x] = size.get(x, 0) + 1
    got = {r.node: (r.label, r.size, r.weight) for r in registry.QUERIES["a41_components"](spark, SF).collect()}
    assert got == {x: (c, size[c], round(1 / size[c], 8)) for x, c in label.items()}
