"""The Merkle manifest against a plain tree in Python, and against its SQL."""

import hashlib
import zlib
from collections import Counter

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from marketgrid.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    out = ""
    for k, x in enumerate(row):
        if x is None:
            out += "-"
            continue
        x = str(x)
        if lower and k == 4:
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
        out += f"{len(x.encode())}:{x}"
    return digest(out)


def tree(digests):
    layers = [digests]
    while len(layers[-1]) > 1:
        layers.append([digest(*layers[-1][k : k + 16]) for k in range(0, len(layers[-1]), 16)])
    return layers


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]])
    top, out = tree([trees[g][-1][0] for g in names]), []
    for at_top, g in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = leaf_of(r, True) if hit else leaf, ""
            for layers, k in ((trees[g], at), (top, at_top)):
                for layer in layers[:-1]:
                    first = k // 16 * 16
                    before, after = "".join(layer[first:k]), "".join(layer[k + 1 : first + 16])
                    proof, node, k = proof + before + after, digest(before, node, after), k // 16
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], digest(proof), node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture
def run(spark, tmp_path):
    def of(rows):
        path = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("grp", F.lit("x")).write.parquet(f"{path}/documents.parquet")
        return Counter(map(tuple, merkle.op11_merkle_manifest(spark, path).collect()))

    return of


def test_supplied_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert Counter(map(tuple, merkle.op11_merkle_manifest(spark, sf).collect())) == Counter(brute(map(tuple, rows)))
    assert differences(spark, connect(sf), merkle.op11_merkle_manifest, merkle.OP11_SQL, sf) == ""


def test_two_rounds_nulls_repeats_and_many_groups(run):
    rows = [(7 * k % 6007, "hot", "en", k, f"Text {k}") for k in range(4200)]  # one block and a lone run after it
    rows += [(k, f"é{k}" if k % 2 else f"z{k}", None, None, "A" * k) for k in range(40)]
    rows += [(1, None, "en", 3, None), (None, None, None, None, None), (None, "hot", "de", 1, "Q"), (5, "lone", "en", 0, "")]
    rows += [(5, "lone", "en", 0, "")] * 3 + [(5, "lone", "en", 0, "other"), (9, "", "en", 1, "x" * 200_000)]
    assert run(rows) == Counter(brute(rows))


def test_edges(run):
    assert run([]) == Counter()
    for rows in ([(3, "a", "b", 1, "C")], [(k, "a", "b", 1, "C") for k in range(17)], [(k, str(k), "b", 1, "C") for k in range(300)]):
        assert run(rows) == Counter(brute(rows))


def test_changed_leaf_shows(spark):
    made = merkle.manifest(spark.createDataFrame([(k, "s", merkle._h([str(k)])) for k in range(100)], "doc_id long, source string, leaf string"))
    rows = made.withColumn("same", merkle.fold("leaf", "proof") == F.col("root")).withColumn("other", merkle.fold(F.lit("0" * 64), "proof") == F.col("root")).collect()
    assert len(rows) == 100 and all(r.same and not r.other for r in rows)


def test_queue_climbs_like_the_tree():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 1000, 4096):
        leaves = [digest(str(k)) for k in range(n)]
        layers = tree(leaves)
        assert merkle.climb(iter(leaves), len(layers) - 1) == layers[-1][0]
