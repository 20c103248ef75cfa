"""Operators on documents against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketgrid.llm import jaccard_join, licenses, quality, secrets, substring_dedup

WORDS = ["the", "of", "and", "thoner", "entin", "shore", "ingwhat", "restion", "andly", "ofther", "stan", "erand", "inou", "bleth"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def brute_components(rows):
    sets = []
    for ident, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((ident, {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())))
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {ident: (len(s), find(ident)) for ident, s in sets}


@pytest.mark.parametrize(("block", "wide"), [(256, 64), (8, 64), (8, 0)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, block, wide):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "WIDE", wide)  # 0: large groups meet by tile
    rng, texts = random.Random(3), []
    for n in (3, 4, 6, 9, 20, 60, 150, 400):
        base = prose(rng, n).split()
        texts += [" ".join(base)] * 3
        for edits in (1, 1, 2, 3, 5, 8, 13):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(copy))
    family = prose(rng, 200).split()
    for _ in range(40):  # a large group of near copies, some further apart than the threshold
        copy = list(family)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    texts += [None, "", " \n", "One", "one", "two Words", "TWO\twords"]
    rng.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, label int, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(frame).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.link(frame.limit(0)).count() == 0
    kept = {r.doc_id for r in jaccard_join.keep_one(frame).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_tiles_of_linking_sets_meet():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(6, 400)
        base = [rng.randrange(1 << 62) for _ in range(n)]
        most = jaccard_join.most_apart(n)
        cut = rng.randrange(most + 1)
        import numpy as np

        x = np.unique(np.array(base, np.uint64))
        y = np.unique(np.array(base[cut:], np.uint64))
        if 100 * len(y) >= 85 * len(x) and not np.array_equal(x, y):
            assert set(jaccard_join.tiles(x)) & set(jaccard_join.tiles(y))


def test_nulls_and_repeats_in_jaccard(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (2, "a B c d e"), (9, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.link(frame).collect())
    assert got == Counter({(None, None): 1, (5, 2): 2, (2, 2): 1, (9, 9): 1})


def test_texts_under_one_id_stay_apart_and_one_row_of_each_group_stays(spark):
    one, two = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(3, two), (5, one), (5, two), (7, one), (7, one), (None, one), (None, "a text that only rows without an id have"), (None, "a text that only rows without an id have"), (9, ""), (9, ""), (10, None)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, h1 int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(frame).collect())
    assert got[5, 7, 5] == 1 and got[5, 7, 3] == 1 and got[7, 7, 5] == 2 and got[3, 7, 3] == 1 and got[9, 0, 9] == 2
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(frame).collect()), key=str)
    assert kept == sorted([(3, two), (5, one), (None, rows[6][1]), (9, ""), (10, None)], key=str)


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_equals_brute_force(spark):
    rng = random.Random(1)
    clean = ". ".join(prose(rng, 12) for _ in range(20))
    texts = [None, "", "a b\na b\n \na b", clean, clean.upper(), "x### y$$$ " * 60, "one two three " * 40, "a\x1cb\xa0c  d\n\n" * 30, prose(rng, 49), prose(rng, 50)]
    frame = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality.measure(frame).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(text)
    assert got[3].kept and got[9].kept
    assert not any(got[k].kept for k in (0, 1, 2, 4, 5, 6, 8))
    assert {r.doc_id for r in quality.keep_good(frame).collect()} == {k for k, r in got.items() if r.kept}
    assert quality.measure(frame.limit(0)).count() == 0


KINDS = (("assign", secrets.ASSIGN), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))


def test_secrets_base_and_random(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    prefix = " ".join(prose(rng, 30) for _ in range(20))
    texts = [
        None, "", prefix, f'{prefix} Password = "abcd1234.x" and API_KEY:zz', "AKIA" + "A" * 11 + " AKIA" + "B" * 12, "x" + "0af" * 11 + " " + "0a" * 15,
        f"{prefix} é{key} tail", "token=short secret='longenough'", "ſecret=abcdefghij toKen=abcdefghij",
    ]
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.find(frame).collect()}
    for k, text in enumerate(texts):
        spans = []
        for order, (name, pattern) in enumerate(KINDS):
            for m in pattern.finditer(text or ""):
                if name == "assign" and len(m[2]) >= 8 or name == "access" and len(m[0]) >= 16 or name == "hex" and len(m[0]) >= 32:
                    spans.append((m.start(), order, f"{name}:{m.start()}:{m.end()}"))
        base = ",".join(s[2] for s in sorted(spans))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[k].spans.split(","))
    assert "random" in got[6].spans and "random" not in got[2].spans
    start = texts[6].index(key)
    assert f"random:{start}:{start + 44}" in got[6].spans
    clean = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert clean[2] == prefix and key not in clean[6] and "abcd1234" not in clean[3] and clean[0] is None
    assert secrets.find(frame.limit(0)).count() == 0


def test_secret_of_many_rows_is_still_random(spark):
    rng = random.Random(12)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(k, prose(rng, 60) + (f" {key} " if k % 3 == 0 else " ") + prose(rng, 60)) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.find(frame).collect()}
    assert all(("random" in spans[k]) == (k % 3 == 0) for k, _ in rows)
    assert not any(key in r.text for r in secrets.redact(frame).collect())


def test_substring_dedup_short_units_and_running_text(spark):
    rng = random.Random(14)
    lines = [prose(rng, 3) for _ in range(20)]
    talk = " ".join(prose(rng, 2).capitalize() + "." for _ in range(12))
    rows = [(k, "\n".join([prose(rng, 30), *lines, prose(rng, 30), talk, prose(rng, 30)])) for k in range(4)]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 4):
        own = rows[k][1].split("\n")
        assert got[k].split("\n") == [own[0], own[21], own[23]]
    # Lines that are common one by one, but not in this order, stay.
    mixed = [(10, "\n".join(lines)), (11, "\n".join(rng.sample(lines, 20)))]
    assert all(not substring_dedup.windows(substring_dedup.units(t)) == [] for _, t in mixed)
    left = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(mixed, "doc_id long, text string")).collect()}
    assert left[11] == mixed[1][1]
    # Passages of 51 words inside running text without ends of sentences.
    missed = 0
    for _ in range(1000):
        passage = prose(rng, 51)
        one, two = (f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(2))
        shared = {u[2] for u in substring_dedup.units(one)} & {u[2] for u in substring_dedup.units(two)}
        missed += sum(len(x.split()) for x in shared) < substring_dedup.MIN_WORDS
    assert missed <= 5


def test_substring_dedup_keeps_the_first(spark):
    rng = random.Random(4)
    sentence = lambda n: prose(rng, n).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(8))
    own = {k: [sentence(12) for _ in range(6)] for k in range(6)}
    rows = [
        (1, "\n".join(own[1])), (4, "\n".join([*own[2][:3], passage, *own[2][3:]])), (2, " ".join([*own[3], passage, *own[3][:0]])),
        (7, "\n".join([passage, *own[4]])), (8, None), (9, ""), (None, passage), (5, "\n".join([own[5][0], own[5][1], own[5][0]])),
    ]
    frame = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, removed string")
    got = {r.doc_id: r for r in substring_dedup.dedup(frame).collect()}
    texts = dict(rows)
    assert got[1].text == texts[1] and got[2].text == texts[2] and got[None].text == passage  # the smallest id keeps it
    assert passage[:40] not in got[4].text and passage[:40] not in got[7].text
    assert all(x in got[4].text for x in own[2]) and all(x in got[7].text for x in own[4])
    assert [texts[7][s.start : s.end] for s in got[7].removed] == [passage + "\n"]  # with the line's end, which goes along
    assert got[8].text is None and got[9].text == "" and got[5].text == "\n".join(own[5][:2])
    whole = substring_dedup.dedup_rows(frame)
    assert whole.columns == frame.columns and {r.doc_id: r.text for r in whole.collect()} == {k: v.text for k, v in got.items()}
    assert substring_dedup.dedup(frame.limit(0)).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    """Digests that the jobs find are those of a dictionary; kept text is the original without the spans, byte for byte."""
    rng = random.Random(21)
    shared = [prose(rng, n) + "." for n in (5, 8, 12, 30, 60)]
    rows = []
    for k in range(40):
        parts = [prose(rng, rng.randrange(1, 40)) for _ in range(6)] + rng.sample(shared, 2)
        rng.shuffle(parts)
        rows.append((k, rng.choice(["\n", "\n\n", " ", "  ", "\n    "]).join(parts) + rng.choice(["", "\n", "  "])))
    first = {}
    for k, text in rows:
        found = substring_dedup.units(text)
        for u in [*found, *substring_dedup.windows(found)]:
            first.setdefault(u[2], k)
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        found = substring_dedup.units(text)
        repeated = {substring_dedup._digest(u[2]) for u in [*found, *substring_dedup.windows(found)] if first[u[2]] < k}
        want, spans = substring_dedup._cut(text, repeated)
        assert got[k].text == want and [(s.start, s.end) for s in got[k].removed] == spans
        kept, at = "", 0
        for start, end in spans:
            kept, at = kept + text[at:start], end
        assert got[k].text == kept + text[at:]
        # Whole lines of five words and more that an earlier document has are gone, all others of one document stay.
        for line in text.split("\n"):
            normal = " ".join(line.split()).lower()
            if first.get(normal, k) < k and len(normal.split()) >= 5:
                assert normal not in got[k].text.lower().split("\n")


def test_battery_and_false_discovery(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    keys = ["".join(rng.choice(letters, 40)) for _ in range(300)]
    passed = [secrets.battery(k, 62) for k in keys]
    assert 0.2 < float(np.median(passed)) < 0.8 and sum(p < 0.05 for p in passed) < 40  # p-values of uniform strings are near uniform
    assert secrets.battery("theseareseveraleasyenglishletterstreesseeneseetheten", 36) < 0.05 and secrets.battery("a" * 40, 36) < 1e-6
    text = random.Random(5)
    frame = spark.createDataFrame([(k, " ".join(prose(text, 20) for _ in range(10))) for k in range(40)], "doc_id long, text string")
    log_text = secrets.text_model(secrets.pair_counts(frame, "text"))
    null = secrets.null_counts(spark, log_text)
    assert (null[:, 0] == secrets.DRAWS).all() and (np.diff(null, axis=1) <= 0).all()
    # The longer ordinary text is, the more seldom it looks random.
    assert (np.diff(null[:, 500]) <= 0.02 * secrets.DRAWS).all() and null[-1, 500] < 0.05 * secrets.DRAWS
    row = secrets.span_finder(log_text, null)
    scores = [t["score"] for k in keys[:50] for t in row(f"word {k} word")[4]]
    assert len(scores) == 50 and min(scores) > 50
    assert all(t["score"] < 50 for t in row("thonerentinshoreingwhat restionandlyoftherstanerand " * 3)[4])
    # A candidate that touches a base span is not tested, however many there are.
    many = " ".join(f"token={k}" for k in keys) + " " + keys[0]
    assert [many[t["start"] : t["end"]] for t in row(many)[4]] == [keys[0]]


def test_licences(spark):
    rng = random.Random(6)
    sentences = [f for f in licenses.TEMPLATES.items()]
    rows = [(0, None), (1, ""), (2, "\n".join(prose(rng, 20) for _ in range(30))), (3, "He lost the license of his driver. " + prose(rng, 30))]
    rows += [(10 + k, prose(rng, 25) + "\n" + s[0] + "\n" + prose(rng, 20)) for k, (_, s) in enumerate(sentences)]
    rows += [(100 + k, "\n".join(prose(rng, 15) for _ in range(10))) for k in range(60)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, families string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    for k, (family, s) in enumerate(sentences):
        assert got[10 + k].families == [family]
        span = got[10 + k].spans[0]
        assert dict(rows)[10 + k][span.start : span.end] == s[0]
    assert not any(got[i].families for i, _ in rows if i < 10 or i >= 100)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_licence_model_on_held_out_rows(spark):
    rng = random.Random(16)
    frame = spark.createDataFrame([(k, "\n".join(prose(rng, 15) for _ in range(6))) for k in range(80)] + [(None, None), (80, "")], "doc_id long, text string")
    model = licenses.train(frame, "doc_id", "text")
    held = licenses.training_rows([prose(rng, 12).split() for _ in range(20)], seed=1234)
    right = sum(model.classify(tokens)[0] == family for family, tokens in held)
    wrong = sum(model.classify(tokens)[0] not in (family, licenses.UNKNOWN) for family, tokens in held)
    assert right >= 0.85 * len(held) and wrong <= 0.02 * len(held)
    talk = ("They argued whether a license is needed to sell fish.", "The copyright of the song belongs to her.", "He explained the Apache license to us.", prose(rng, 15))
    assert all(model.classify(licenses.words(t))[0] == licenses.UNKNOWN for t in talk)
    # No licence word in it: found by the classifier alone.
    bare = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."
    assert model.classify(licenses.words(bare))[0] == "Unlicense"
    # The bound that spares the soft-max never changes a verdict.
    for family, tokens in held[::7]:
        found = model.found(tokens)
        p = licenses._softmax(model.logits(found) / model.temperature)
        best = int(p.argmax())
        sure = model.families[best] != licenses.UNKNOWN and p[best] >= model.least and model.confirmed(model.families[best], tokens)
        assert (model.classify(tokens)[0] != licenses.UNKNOWN) == sure


LICENCE_PROBES = [
    ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.', ["MIT"]),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', ["MIT"]),
    ("Distributed under the MIT licence.", ["MIT"]),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache"]),
    ("License: GPL-3.0-or-later", ["GPL"]),
    ("Code is Apache 2.0 licensed.", ["Apache"]),
    ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:", ["BSD"]),
    ("We compared code licensed under the MIT license with ours.", []),
    ("Never write that your work is licensed under the MIT license unless you mean it.", []),
    ("The project is not released under the GPL.", []),
    ("He bought a house.\nShe sold it.", []),
    ("word " * 50_000 + "\nReleased under the ISC License.\n" + "word\n" * 20_000, ["ISC"]),
    (None, []),
    ("", []),
]


def test_licences_as_they_stand_in_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = licenses.train(docs, "doc_id", "text")
    licenses.save(model, spark, str(tmp_path / "model"))
    kept = licenses.load(spark, str(tmp_path / "model"))
    assert kept.to_json() == model.to_json()
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LICENCE_PROBES)], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(frame, model=kept).collect()}
    for k, (text, want) in enumerate(LICENCE_PROBES):
        assert found[k].families == want, text and text[:80]
        assert all(0 <= s.start < s.end <= len(text) for s in found[k].spans)


def test_wrapped_sentences_have_original_offsets():
    text = "One\ntwo. Three four.\n\nFive.\nSix\n  seven"
    assert [text[a:b] == s and s for a, b, s in licenses.wrapped(text)] == ["One\ntwo.", "Six\n  seven"]


def test_texts_of_a_large_group_travel_only_where_bitmaps_leave_room(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng, rows, worked = random.Random(12), [], {}
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))  # in common, so that the sets hang together
    for k in range(0, 300, 2):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((k, f"{passage} {' '.join(own)}"))
        if k % 30 == 0:
            rows.append((k + 1, f"{passage} {' '.join([*own[:-2], 'other', 'end'])}"))
    ties = jaccard_join._ties

    def counted(scratch, work, texts, name, *rest):
        worked[name] = work.count()
        return ties(scratch, work, texts, name, *rest)

    monkeypatch.setattr(jaccard_join, "_ties", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link(frame).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}
    assert worked.get("open-ties", 0) <= len(rows)


def test_bitmaps_leave_room_for_every_link():
    rng, left, right, links = np.random.default_rng(4), [], [], set()
    for n in (1, 3, 15, 16, 17, 31, 33, 60, 64, 70, 500, 40000):
        for apart in (0, 1, 2, n // 9, n // 6):
            both = rng.integers(1 << 62, size=max(1, n - apart), dtype=np.uint64)
            left.append(np.unique(both))
            right.append(np.unique(np.concatenate([both, rng.integers(1 << 62, size=apart, dtype=np.uint64)])))
    links = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if jaccard_join.linked(x, y, 80)}
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    packed = [[jaccard_join.sketch(x) for x in side] for side in (left, right)]
    found = {(int(i), int(j)) for a, b in jaccard_join.sketches_may_link(packed[0], sizes[0], packed[1], sizes[1], 80) for i, j in zip(a, b, strict=True)}
    assert links and links <= found and len(found) < len(left) * len(right) // 4
