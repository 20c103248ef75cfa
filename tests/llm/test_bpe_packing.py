import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketgrid.llm import bpe, packing
from marketgrid.llm.bpe_automaton import automaton
from marketgrid.llm.common import vocabulary_path

ODD = [
    None, "", " ", "\n\n", "a", "  two  blanks ", "it's we'll 12x3 ３½ ٣", "日本語 текст ümlaut", "<|endoftext|>", "x<|endoftext|> y<|endo",
    "\x1c\x85​\ttab \r\n", "=" * 300, "word " * 2000, "😀👍🏽 ﬁ ſ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids(text):
    return np.frombuffer(automaton(vocabulary_path()).encode_packed(text or ""), "<u4").tolist()


def test_encoding_equals_the_library(library):
    rng = random.Random(5)
    letters = "aaabe thTHE  \n\t'sll12３é日\x85 ​😀.,!?-ſ٣"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(2000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(text) == want, repr(text)
        assert automaton(vocabulary_path()).decode_packed(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


def test_op1_over_a_table(spark, library):
    rows = [(k, t, "other", k) for k, t in enumerate(ODD)] + [(3, ODD[3], "again", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = bpe.round_trip(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    coded = bpe.encode(frame)
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.round_trip(frame.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [5, 20, 2048])
def test_plan_fills_bins_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 40)))}
        bins, placed = defaultdict(list), Counter()
        for length, low, high, first, per, used in packing.plan_best_fit(counts, capacity):
            for k in range(high - low):
                bins[first + k // per].append((used + k % per * length, length))
                placed[length] += 1
        assert placed == Counter(counts)
        for held in bins.values():
            end = 0
            for offset, length in sorted(held):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(bins) == one_by_one(counts, capacity)
        assert len(bins) >= -(-sum(n * c for n, c in counts.items()) // capacity)


def one_by_one(counts, capacity):
    """Sequences that best-fit decreasing needs when it takes the pieces one after the other."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_automaton_starts_over_when_its_states_are_too_many(library, monkeypatch):
    from marketgrid.llm import bpe_automaton
    from marketgrid.llm.common import vocabulary_path

    monkeypatch.setattr(bpe_automaton, "MAX_STATES", 40)
    coder, rng = bpe_automaton.BpeAutomaton(vocabulary_path()), random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("aeioutnsrlhdéç中0 \n!<") for _ in range(rng.randrange(1, 60)))
        assert np.frombuffer(coder.encode_packed(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
        assert coder.decode_packed(coder.encode_packed(word)) == word
    assert len(coder.last) <= 40 + 60


def test_long_words_are_linear(library):
    import time

    from marketgrid.llm.bpe_automaton import automaton
    from marketgrid.llm.common import vocabulary_path

    coder, began = automaton(vocabulary_path()), time.perf_counter()
    packed = coder.encode_packed("x" * 300_000 + " " + "ab" * 150_000)
    assert time.perf_counter() - began < 10
    assert np.frombuffer(packed, "<u4")[:1000].tolist() == library.encode("x" * 300_000, add_special_tokens=False).ids[:1000]


def test_op9_packs_every_token_once(spark, library):
    rows = [(k, t, 7) for k, t in enumerate(ODD)] + [(100 + k, "same text here", 1) for k in range(50)] + [(9, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(frame).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    want = Counter()
    for ident, text, _ in rows:
        tokens = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(tokens) - 1) % packing.CAPACITY + 1
        cuts = [0, *range(first, len(tokens) + 1, packing.CAPACITY)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[ident, piece, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack(frame.limit(0)).count() == 0


def small_vocabulary(folder, merges):
    """A vocabulary file of the bytes and the given merges, whose ids follow ``merges``' own numbers."""
    import json

    from marketgrid.llm.bpe_automaton import _visible_bytes

    vocab = {c: k for k, c in enumerate(_visible_bytes())} | {a + b: k for (a, b), k in merges}
    path = folder / "vocabulary.json"
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "vocab": vocab, "merges": [list(m) for m, _ in merges]}
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": pre, "decoder": pre, "model": model}))
    return str(path)


def test_ranks_give_the_library_s_ids(library):
    from marketgrid.llm import ranks

    path, rng = vocabulary_path(), random.Random(8)
    assert ranks.ranks_suffice(path)
    pack = ranks.encoder(path, True)
    letters = "aaabe thTHE  \n\t'sll12３é日\x85 ​😀.,!?-ſ٣\x1c﻿ "
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(2000)]
    texts += ["x" + " " * 200_000 + "y<|endoftext|>", "\n" * 200_000, "é" * 50_000, " <|endoftext|><|endoftext|> \n"]
    for text in texts:
        assert pack(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:60])


@pytest.mark.parametrize(
    "merges, suffice",
    [
        ([(("b", "c"), 256), (("a", "b"), 257), (("ab", "c"), 258)], False),  # abc is never made: bc is
        ([(("a", "b"), 257), (("b", "c"), 256)], False),  # ids in another order than merges
        ([(("a", "b"), 256), (("ab", "c"), 257), (("b", "c"), 258)], True),
    ],
)
def test_op9_follows_the_merges_of_any_vocabulary(spark, tmp_path, merges, suffice):
    from marketgrid.llm import ranks

    path = small_vocabulary(tmp_path, merges)
    assert ranks.ranks_suffice(path) is suffice
    texts = ["abc", "abcbcab", "xbcabc abab", "", "bcbc é"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(frame, vocabulary=path).collect()}
    other = Tokenizer.from_file(path)
    want = [other.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert got == {k: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for k, w in enumerate(want)}


def test_op9_encodes_new_words_at_half_the_automaton_s_cost():
    import time

    from marketgrid.llm.bpe_automaton import BpeAutomaton

    rng = random.Random(6)
    parts = "the an re tion ed ing er ble ly of ei ch en un".split()
    text = " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(3, 8))) for _ in range(60_000))
    path, seconds = vocabulary_path(), []
    for pack in (packing.encoder(path, True), BpeAutomaton(path).encode_packed):
        began = time.process_time()
        packed = pack(text)
        seconds.append((time.process_time() - began, zlib.crc32(packed)))
    assert seconds[0][1] == seconds[1][1]
    assert seconds[0][0] < seconds[1][0] / 2
