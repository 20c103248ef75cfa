"""Cross-tokenizer alignment against a byte-by-byte version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketgrid.llm import alignment


@pytest.fixture(scope="module")
def plain():
    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def of(text):
        if not text:
            return None
        raw = (" " + text).encode()
        a = [(i, bytes(back[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return None
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted({(i, j) for i, j in zip(*owner)})
        groups, part = [], ([], [])
        for at in range(len(raw)):
            last = at + 1 == len(raw)
            for side, own, tokens in zip(part, owner, (a, b)):
                if last or own[at + 1] != own[at]:
                    side.append((at, tokens[own[at]][0]))
            if all(side and side[-1][0] == at for side in part):
                groups.append("|".join(",".join(str(i) for _, i in side) for side in part))
                part = ([], [])
        return a, b, [(a[i][0], b[j][0]) for i, j in links], ";".join(groups)

    return of


def brute(rows, plain):
    found = [(ident, plain(text)) for ident, text in rows]
    counts = Counter(x for _, f in found if f for x in f[2])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for ident, f in found:
        if f is None:
            out.append((ident, 0, 0, 0, 0, "", 0, 0))
            continue
        a, b, links, groups = f
        out.append((ident, len(a), len(b), groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest(), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)))
    return Counter(out)


ODD = [
    None, "", " ", "  two  blanks ", "\t\n\n x", "<|endoftext|> and <s></s><unk>", "café naïve", "日本語の文章です。" * 30,
    "lower▁bar", "a\u0000b", "\U0001f600\U0001f44d\U0001f3fd", "x" * 5000, "-" * 3000, "<0x41>", "​﻿", "I'd've", "12345678901234567890", "word " * 30000, "ﬁn ½",
]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def got(frame):
    return Counter(tuple(r) for r in alignment.link_counts(frame).select(*COLUMNS).collect())


def test_odd_texts_equal_brute_force(spark, plain):
    rng = random.Random(4)
    alphabet = list("abcdefghij  .,;:'\n\t0123456789") + ["é", "中", "文", "\U0001f600", "the ", "ing"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))) for k in range(150)]
    rows += [(7, "one id again"), (7, "one id again"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, n int").repartition(3)
    assert got(frame) == brute(rows, plain)
    assert alignment.link_counts(frame.limit(0)).count() == 0


def test_supplied_table_equals_brute_force(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in alignment.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()) == brute(rows, plain)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_pieces_of_any_size_give_the_same(work):
    """Seams fall everywhere, common ends among them."""
    rng = np.random.default_rng(work)
    pair = alignment.tokenizers(P.path(alignment.RANKS), P.path(alignment.PIECES))
    texts = ["".join(rng.choice(list("ab c.\né"), rng.integers(1, 60))) for _ in range(40)]
    one, many = alignment.align_texts(texts, pair, 1 << 30), alignment.align_texts(texts, pair, work)
    for name in ("link_a", "link_b", "group_a", "group_b", "cut_links", "cut_groups"):
        assert np.array_equal(getattr(one, name), getattr(many, name)), name
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        pieces = alignment.crossings(x, y, work)
        assert all(p[1] - p[0] + p[3] - p[2] == work for p in pieces[:-1])
        order = sorted([(v, 0) for v in x] + [(v, 1) for v in y])
        taken = [z for a0, a1, b0, b1 in pieces for z in sorted([(v, 0) for v in x[a0:a1]] + [(v, 1) for v in y[b0:b1]])]
        assert taken == order


def test_whole_alignment_is_at_hand(spark, plain):
    rows = [(k, t) for k, t in enumerate(ODD) if t is None or len(t) < 1000]
    for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = plain(dict(rows)[r.doc_id])
        assert ([*r.a], [*r.b]) == (([i for i, _ in want[0]], [i for i, _ in want[1]]) if want else ([], []))
        assert [(r.a[i], r.b[j]) for i, j in zip(r.link_a, r.link_b)] == (want[2] if want else [])
        assert len(r.group_a) == len(r.group_b) == (want[3].count(";") + 1 if want else 0)


def test_chunks_of_few_links_give_the_same_counts(spark):
    pair = alignment.tokenizers(P.path(alignment.RANKS), P.path(alignment.PIECES))
    assert pair.size_a.min() > 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == got(docs.repartition(11))
