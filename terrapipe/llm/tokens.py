"""Hashed tokens for the text classifiers: lower-case words, runs of marks, and their shapes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Vocabulary(dict):
    """token -> (hash of the lower-case token) and, in ``shapes``, hash of its shape."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:  # bounds the memory of a task
            self.clear()
        value = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass"))
        value = (value & ~0xFF) | self.shape(token)
        self[token] = value
        return value

    @staticmethod
    def shape(token: str) -> int:
        """A number under 256 for letter case, digits and rough length of a token."""
        kind = (
            0 if token.islower() else 1 if token.istitle() else 2 if token.isupper() else 3 if token.isalpha()
            else 4 if token.isdigit() else 5 if token.isalnum() else 6 + ord(token[0]) % 8
        )
        return kind * 8 + min(7, len(token).bit_length())


def hashed(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    """One uint64 for each token: the low byte is the shape, the rest the hash."""
    found = _TOKEN.findall(text) if text else []
    return np.fromiter(map(vocabulary.__getitem__, found), np.uint64, len(found))

