"""Token ids of whole texts by the ranks of a byte-level BPE vocabulary, for operators that only need the ids."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .bpe_automaton import _visible_bytes


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


@lru_cache(maxsize=4)
def ranks_suffice(path: str) -> bool:
    """Whether joining the pair of least rank first gives the ids that the vocabulary's merges give.

    It does if each merge makes a token of its own, in the order of ids, and every token's characters
    merge to that token: of the pairs that spell a token, then only the merge's own ever meet.
    """
    spec = _spec(path)
    before, model, special = spec.get("pre_tokenizer") or {}, spec["model"], {t["content"] for t in spec["added_tokens"]}
    vocab = {t: k for t, k in model["vocab"].items() if t not in special}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made, rank = [a + b for a, b in merges], {m: k for k, m in enumerate(merges)}
    ids = [vocab.get(t, -1) for t in made]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or len(special) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return False
    if model.get("dropout") or ids != sorted(set(ids)) or vocab.keys() != {*_visible_bytes(), *made}:
        return False

    def merged(token: str) -> int:
        parts = list(token)
        while len(parts) > 1:
            least = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
            if (parts[least], parts[least + 1]) not in rank:
                break
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        return len(parts)

    return all(merged(t) == 1 for t in made)


@lru_cache(maxsize=4)
def encoder(path: str, by_ranks: bool) -> Callable[[str], bytes]:
    """Packed ids (little-endian unsigned 32-bit) of a text, once in each Python worker.

    ``by_ranks`` is what :func:`ranks_suffice` said; otherwise, and for texts whose runs of white space
    are too long for the ranks' pattern, the vocabulary file's own library encodes.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def library() -> Tokenizer:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return made

    def by_library(text: str) -> bytes:
        return np.array(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if not by_ranks:
        return by_library
    spec, visible = _spec(path), _visible_bytes()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(visible.__getitem__, t)): k for t, k in spec["model"]["vocab"].items() if t not in special}
    ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def pack(text: str) -> bytes:
        try:
            return ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return by_library(text)

    return pack
