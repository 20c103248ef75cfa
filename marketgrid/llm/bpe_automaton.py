"""Byte-level BPE as a deterministic automaton.

Compilation goes merge by merge.  The automaton over tokens starts with one state per byte, every
byte allowed after every other.  The gadget of merge ``(a, b) -> ab``

* removes the arc ``b`` out of state ``a`` (a leftmost merge has consumed that pair),
* adds an arc ``ab`` wherever an arc ``a`` leads to a state that still had arc ``b``,
* lets state ``ab`` start with the arcs that state ``b`` has at that moment.

One row of the gadget tables (``left``, ``right``, ``when``) holds one gadget; whether an arc exists
in the finished automaton follows from undoing the gadgets newest first (:meth:`_arc`).  A path of
the automaton that spells a word is the word's BPE encoding, and there is exactly one.

That automaton reads tokens.  Its determinisation over bytes is what encoding runs: a state is the
set of (token before, node of the byte trie) that are under way, and holds the token that ends the
one path spelling the bytes read.  A transition is one look into a table, (state, byte) -> state;
rows are made by the subset construction when they are first needed, as the whole table would hold
every pair of 50,000 tokens, and are kept in each worker up to a bound.  One run forward over a
word's bytes, no step back; the tokens are then read off the states from the end, each saying where
the one before it ended.  Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex

# The split pattern of byte-level BPE, with the Unicode white-space property spelled out.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_START, _HEAD = -1, 4
#: Encoded chunks, and states of the byte automaton, that a worker keeps.
MAX_CHUNKS, MAX_STATES = 1_000_000, 120_000


def _visible_bytes() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    shifted = (b for b in range(256) if b not in set(plain))
    table.update({chr(256 + k): b for k, b in enumerate(shifted)})
    return table


class BpeAutomaton:
    """Compiled merges of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        vocab, visible = spec["model"]["vocab"], _visible_bytes()
        self.labels: list[bytes] = [b""] * (max(max(vocab.values()), *[t["id"] for t in spec["added_tokens"]], 0) + 1)
        for token, ident in vocab.items():
            if all(c in visible for c in token):
                self.labels[ident] = bytes(visible[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, ident in self.special.items():
            self.labels[ident] = content.encode()
        self._gadgets(vocab, spec["model"]["merges"])
        self._trie()
        self._start()
        self.special_pattern = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.words = regex.compile(SPLIT_PATTERN)
        self._points = {c: self._pack(self.encode_word(c.encode())) for c in ".,;:!?"}
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}

    def _gadgets(self, vocab: dict[str, int], merges: list) -> None:
        """Append the merges' gadgets in order; ``when`` is a token's time of birth, 0 for bytes."""
        size = len(self.labels)
        self.left, self.right, self.when = [-1] * size, [-1] * size, [0] * size
        self.pair_time: dict[int, int] = {}
        for time, merge in enumerate(merges, 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.pair_time.setdefault(left * size + right, time)
            if self.when[made] == 0 and len(self.labels[made]) > 1:
                self.left[made], self.right[made], self.when[made] = left, right, time
        self.size = size
        self._arcs: dict[int, bool] = {}

    def _trie(self) -> None:
        """Byte trie of the vocabulary: for each byte, node -> deeper node; the token that each node spells or -1."""
        self.trie: list[dict[int, int]] = [{} for _ in range(256)]
        self.ends = [-1]
        self.grows = [False]  # whether longer tokens go through a node
        specials = set(self.special.values())
        for ident, label in enumerate(self.labels):
            if not label or ident in specials:
                continue
            node = 0
            for byte in label:
                deeper = self.trie[byte].get(node)
                if deeper is None:
                    deeper = self.trie[byte][node] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = deeper
            self.ends[node] = ident
        self.length = list(map(len, self.labels))

    def _start(self) -> None:
        """The byte automaton's start state: nothing read, no token before."""
        start = ((0,), (_START,))  # nodes under way, and the token before each
        self.table: dict[int, int] = {}
        self.last, self.under_way, self._states = [_START], [start], {start: 0}
        self.heads: dict[bytes, list[int]] = {}

    def _arc(self, p: int, t: int) -> bool:
        """Whether token ``t`` may follow token ``p`` once all gadgets are in place."""
        # Undo gadgets, newest first.
        u, v, limit, allowed = p, t, len(self.pair_time) + self.size, True
        while True:
            time = self.pair_time.get(u * self.size + v)
            if time is not None and time < limit:
                allowed = False
                break
            wu, wv = self.when[u], self.when[v]
            if wu == 0 and wv == 0:
                break
            if wu > wv:
                # State `ab` took over the arcs that state `b` had before this gadget.
                limit, u = wu, self.right[u]
            else:
                # Arcs `ab` follow arcs `a` as they stand after this gadget's removal.
                limit, v = wv + 1, self.left[v]
        return allowed

    def _transition(self, state: int, byte: int) -> int:
        """Add the row of ``table`` for a state and a byte by the subset construction."""
        ends, arcs, grows = self.ends, self._arcs, self.grows
        at, tokens = self.under_way[state]
        nodes, before, token = [], [], _START
        for p, node in zip(tokens, map(self.trie[byte].get, at), strict=True):
            if node is None:
                continue
            if grows[node]:
                nodes.append(node)
                before.append(p)
            if token < 0:
                ended = ends[node]
                if ended >= 0:
                    key = p * self.size + ended
                    allowed = p < 0 or arcs.get(key)
                    if allowed is None:
                        allowed = arcs[key] = self._arc(p, ended)
                    if allowed:
                        token = ended
        nodes.append(0)
        before.append(token)
        name = (tuple(nodes), tuple(before))
        made = self._states.get(name)
        if made is None:
            made = self._states[name] = len(self.last)
            self.last.append(token)
            self.under_way.append(name)
        self.table[state << 8 | byte] = made
        return made

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word: transitions forward, then the tokens from the end.

        The states after the first ``_HEAD`` bytes of a word are kept together, as words share beginnings.
        """
        if len(self.last) > MAX_STATES:
            self._arcs.clear()
            self._start()
        look, last, length = self.table.get, self.last, self.length
        head = word[:_HEAD]
        passed = self.heads.get(head)
        if passed is None:
            passed, state = [], 0
            for byte in head:
                deeper = look(state << 8 | byte)
                state = self._transition(state, byte) if deeper is None else deeper
                passed.append(state)
            self.heads[head] = passed
        ids, at = [], len(word)
        if at > _HEAD:
            passed, state = passed.copy(), passed[-1]
            for byte in word[_HEAD:]:
                deeper = look(state << 8 | byte)
                state = self._transition(state, byte) if deeper is None else deeper
                passed.append(state)
        while at:
            token = last[passed[at - 1]]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _word(self, word: str) -> bytes:
        """Packed ids of one pre-split word; those after a blank share the chunks' table."""
        known, key = (self._chunks, word[1:]) if word[0] == " " else (self._bare, word)
        packed = known.get(key)
        if packed is None:
            packed = self._pack(self.encode_word(word.encode()))
            if len(self._bare) >= MAX_CHUNKS // 4:
                self._bare.clear()
            known[key] = packed
        return packed

    def _encode_plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        return b"".join(map(self._word, self.words.findall(text)))

    def _chunk(self, part: str) -> bytes | None:
        """Ids of a blank and what follows it up to the next one; None if white space makes them depend on more."""
        packed = self._older.get(part)
        if packed is None:
            if part.isalpha():
                packed = self._pack(self.encode_word(b" " + part.encode()))
            elif not part or part[0].isspace() or part[-1].isspace():
                return None
            elif part[-1] in self._points and part[:-1].isalpha():
                packed = (self._chunks.get(part[:-1]) or self._chunk(part[:-1])) + self._points[part[-1]]
            else:
                packed = self._encode_plain(" " + part)
        if len(self._chunks) >= MAX_CHUNKS // 2:
            self._older, self._chunks = self._chunks, {}
        self._chunks[part] = packed
        return packed

    def _encode_segment(self, text: str) -> bytes:
        # Every single blank starts a new word, so what stands between blanks encodes by itself.
        first, *parts = text.split(" ")
        if first and first[-1].isspace() or parts and not first:
            return self._encode_plain(text)
        found, at = list(map(self._chunks.get, parts)), -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            packed = self._chunks.get(parts[at]) or self._chunk(parts[at])
            if packed is None:
                return self._encode_plain(text)
            found[at] = packed
        return self._encode_plain(first) + b"".join(found)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens' strings are special."""
        if not text:
            return b""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._encode_segment(text)
        out = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.append(self._encode_segment(part))
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> str:
        """The text that the arcs' labels spell, invalid UTF-8 replaced."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def automaton(path: str) -> BpeAutomaton:
    """The compiled automaton of a vocabulary file, once in each Python worker."""
    made = BpeAutomaton(path)
    gc.collect()
    gc.freeze()  # the tables stay; the collector need not walk them again and again
    return made
