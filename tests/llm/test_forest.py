"""The LSH forest's classes against all pairs."""

import random

import numpy as np
import pytest
from test_documents import prose

from marketgrid.llm import jaccard_join, lsh_forest


def brute(rows, width=5, percent=85):
    sets = []
    for ident, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((ident, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {ident: (len(s), find(ident), find(ident) == ident) for ident, s in sets}


def near_copies(rng, base, n, most):
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, most)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("block", "wide"), [(256, 64), (8, 0)])
def test_classes_equal_brute_force(spark, monkeypatch, block, wide):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    rng, texts = random.Random(11), []
    for n in (3, 5, 9, 12, 25, 60, 150, 400, 3000):
        base = prose(rng, n).split()
        texts += [" ".join(base)] * 3
        for edits in (1, 1, 2, 3, 5, 8, 13):
            texts += list(near_copies(rng, base, 1, edits + 1))
    texts += list(near_copies(rng, prose(rng, 200).split(), 60, 7))  # one large group, parts of it below the threshold
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(30)]  # a passage in common, no links
    texts += [None, "", " \n", "One", "one", "two Words", "TWO\twords", "İstanbul ÄÖ", "istanbul äö"]
    rng.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, label int, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_edges(spark):
    text = prose(random.Random(2), 50)
    frame = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (9, None), (9, None), (None, None), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(frame).select("doc_id", "n_shingles", "component_id", "kept").collect() if r.doc_id)
    assert got == [(2, 46, 2, True), (4, 46, 2, False), (4, 46, 2, False), (7, 0, 7, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert lsh_forest.near_duplicates(frame).count() == 8
    assert lsh_forest.near_duplicates(frame.limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets_overlap():
    rng, agree = np.random.default_rng(5), []
    for _ in range(60):
        both, own = rng.integers(1 << 62, size=170, dtype=np.uint64), rng.integers(1 << 62, size=30, dtype=np.uint64)
        x, y = np.concatenate([both, own[:15]]), np.concatenate([both, own[15:]])
        agree.append((lsh_forest.signature(x) == lsh_forest.signature(y)).mean())
    assert abs(np.mean(agree) - 0.85) < 0.02


def test_linking_sets_meet_in_a_region():
    rng, met = np.random.default_rng(6), 0
    for _ in range(400):
        both, own = rng.integers(1 << 62, size=340, dtype=np.uint64), rng.integers(1 << 62, size=60, dtype=np.uint64)
        x, y = np.concatenate([both, own[:30]]), np.concatenate([both, own[30:]])
        met += bool(set(lsh_forest.forest(x)[0]) & set(lsh_forest.forest(y)[0]))
    assert met == 400


def test_neighbours_have_the_longest_common_prefix():
    place = np.array([0b01, 0b01, 0b01 << 45, 0b11 << 45, 5, 5 | 1 << 15], np.int64)
    order = np.lexsort([place, [1, 1, 1, 1, 2, 2]])
    rows = np.stack([np.array([1, 1, 1, 1, 2, 2])[order], np.arange(6), place[order]])
    ties = jaccard_join._near(rows)
    assert set(zip(ties.column(2).to_pylist(), ties.column(3).to_pylist())) == {(0, 1), (1, 2), (2, 3), (4, 5)}
