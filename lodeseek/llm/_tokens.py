"""Byte-level BPE ids of whole texts, by pre-token: each distinct pre-token is encoded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import regex

#: Pre-tokens that a worker remembers; the oldest half goes when there are more.
CACHE = 600_000
#: Longer pre-tokens aren't remembered.
CACHE_CHARS = 64


class Pieces:
    """Maps a text's pre-tokens (matches of pattern) to what encode makes of them."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], Iterable]):
        self.split, self.encode, self.known = regex.compile(pattern).findall, encode, {}

    def of(self, text: str) -> list:
        words = self.split(text)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            known.update(zip(new, self.encode(new)))
        out = [known[w] for w in words]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        if len(known) > CACHE:
            for w in list(known)[: CACHE // 2]:
                del known[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """A function from a text to its ids (an array of uint32), as the tokenizers library gives them by its default settings.

    In a byte-level BPE file ids follow the order of merges, so that they serve as ranks; added
    tokens in a text are ids of their own. The tests hold the ids against the library's. Added
    tokens that need more than a plain search are refused.
    """
    import json

    import tiktoken

    from .byte_bpe import byte_characters

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"]):
        raise ValueError("an added token isn't a plain text")
    added = {t["content"]: t["id"] for t in made["added_tokens"]}
    byte = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(byte[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in added}
    encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added).encode_to_numpy
    return lambda text: encode(text, allowed_special="all")


def ids_of(path: str, pattern: str, text: str, end: int | None = None):
    """Ids of a whole text as a numpy array of uint32, and end after them."""
    import numpy as np

    got = encoder(path, pattern)(text)
    return got.astype("<u4") if end is None else np.append(got, np.uint32(end)).astype("<u4", copy=False)
