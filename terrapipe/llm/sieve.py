"""Filters of bounded size over hashed keys, and the token ids that the counting operators share.

A key that was put into a sieve always passes it; another one passes rarely, and more often the more
keys the sieve holds beyond its size. So a sieve may only ever spare work, never decide a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLICE = 1 << 13  # words of a slice: 64 KB
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit keys, another one for each salt."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _ODD
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _spots(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, and its four bits there."""
    mask = np.zeros(len(keys), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
    return (keys & np.uint64(words - 1)).astype(np.int64), mask


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may have been put into the sieve."""
    at, mask = _spots(keys, len(bits))
    return (bits[at] & mask) == mask


def sieve(keys: DataFrame, max_bytes: int = 32 << 20, bits_per_key: int = 32) -> np.ndarray:
    """The sieve of a table of one long column, read twice. No more than ``max_bytes`` reach the driver.

    Each task settles whole slices and returns one row for each; an empty table gives a sieve that
    nothing passes.
    """
    wanted = max(_SLICE, keys.count() * bits_per_key // 64)
    words = min(1 << (wanted - 1).bit_length(), max(_SLICE, 1 << ((max_bytes // 8).bit_length() - 1)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            at, mask = _spots(batch.column("key").to_numpy().view(np.uint64), words)
            order = np.argsort(at, kind="stable")
            at, mask = at[order], mask[order]
            for k in np.unique(at // _SLICE).tolist():
                a, b = np.searchsorted(at, (k * _SLICE, (k + 1) * _SLICE))
                own = slices.setdefault(k, np.zeros(_SLICE, np.uint64))
                np.bitwise_or.at(own, at[a:b] - k * _SLICE, mask[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(slices), pa.int64()), pa.array([x.tobytes() for x in slices.values()], pa.binary())],
            names=["slice", "bits"],
        )

    key = F.col(keys.columns[0])
    bits = np.zeros(words, np.uint64)
    dealt = keys.select(key.alias("key")).repartition(F.shiftrightunsigned(key.bitwiseAND(words - 1), 13))
    for row in dealt.mapInArrow(fill, "slice long, bits binary").toLocalIterator():
        bits[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["bits"], np.uint64)
    return bits


class Tokens(dict):
    """Ids of byte tokens, given out as they come, and a hash of each."""

    def __init__(self, *first: bytes) -> None:
        super().__init__()
        self.names: list[bytes] = []
        self._hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
        for token in first:
            self[token]

    def __missing__(self, token: bytes) -> int:
        self[token] = len(self.names)
        self.names.append(token)
        return len(self.names) - 1

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def hashes(self, hasher: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> np.ndarray:
        """The hash of each token by its id."""
        done = len(self._hashes[0])
        if done < len(self.names):
            new = np.fromiter(map(hasher, self.names[done:]), np.uint64, len(self.names) - done)
            self._hashes[0] = np.r_[self._hashes[0], new]
        return self._hashes[0]


def raw(column: pa.Array) -> list[bytes | None]:
    """The strings of a column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())
