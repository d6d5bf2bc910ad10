"""Token ids of whole texts under a byte-level vocabulary, at the speed of a word cache.

The split rule of the vocabulary never joins a non-space character with the white
space after it, so a text can be cut before every single space and each part encoded
alone.  Parts repeat, so each task keeps their ids.  Texts in which a space stands
inside a longer run of white space (or with unusual white space) are encoded whole.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: A run of white space that a cut would split, or white space that libraries class differently.
_UNSAFE = re.compile("\\s \\s|[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
CACHE_PARTS = 400_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Parts(dict):
    """Little-endian unsigned 32-bit ids of a part, found once and kept."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encode(self.prefix + part), dtype="<u4").tobytes()
        if len(self) >= CACHE_PARTS:
            self.clear()
        self[part] = ids
        return ids


class ByteTokens:
    """``ids(text)`` gives the bytes of the ids of a whole text."""

    def __init__(self, ranks_path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or default_ranks(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # fixed value: the one special string of this vocabulary and its id
        self.special = {"<|endoftext|>": 50256} if special is None else special
        self.encoding = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.after_space = _Parts(self.encoding.encode_ordinary, " ")
        self.at_start = _Parts(self.encoding.encode_ordinary, "")

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        if _UNSAFE.search(text):
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))
