"""Byte-level BPE ids, equal to those of the ``tokenizers`` library for the same vocabulary file, from a faster engine."""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Loads the vocabulary at ``path`` once in each worker.

    ``ids`` are those of the library's default settings: a string of an added token in a text becomes that token's id.
    To ``encode`` such strings are ordinary text.
    """

    _LOADED: dict[str, "Encoder"] = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._LOADED:
            cls._LOADED[path] = cls(path)
        return cls._LOADED[path]

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        if any(t.get(k) for t in vocabulary["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in blanks or whole words only are not supported")
        if any(a != b and a.startswith(b) for a in special for b in special):
            raise ValueError("added tokens that begin with one another are not supported")
        to_byte = _byte_letters()
        # in such a file ids follow the order of the merges, so an id is also its token's rank
        ranks = {bytes(to_byte[ch] for ch in t): n for t, n in vocabulary["model"]["vocab"].items() if t not in special}
        self.engine = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.engine.encode_ordinary(text), np.uint32)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.engine.encode(text, allowed_special="all"), np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
