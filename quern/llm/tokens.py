"""Words of whole Arrow batches of texts as numpy arrays.

The texts of a batch are decoded to one array of code points. A table over all code points gives
each its class and its lower-case form, so finding word borders and hashing words are a few
passes over that array.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

WORD, PUNCT, SPACE = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point (lower-case forms of several characters are left out)."""
    space = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kind = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if c in space:
            kind[c] = SPACE
        elif c < 0x20000 or c > 0xE0000:
            ch = chr(c)
            if unicodedata.category(ch)[0] == "P":
                kind[c] = PUNCT
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return kind, lower


@cache
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _ODD))))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of splitmix64."""
    z = x.astype(np.uint64) + _ODD
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def _mixed_table() -> np.ndarray:
    return mixed(np.arange(0x110000, dtype=np.uint64))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts (NULL counts as empty) and the index of the text of each."""
    values = [t or "" for t in texts.to_pylist()]
    cps = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.repeat(np.arange(len(values)), [len(v) for v in values])


def run_hashes(cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run cps[start : start + length]."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = int(lengths.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars = cps[inner + np.repeat(starts, lengths)]
    longest = int(lengths.max())
    power = _powers(1 << max(6, (longest - 1).bit_length()))[inner]
    return mixed(np.add.reduceat(_mixed_table()[chars] * power, np.cumsum(lengths) - lengths))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, start (in the joined code points) and length of every word, in order, ignoring case."""
    kind, lower = tables()
    cps, doc = code_points(texts)
    inside = kind[cps] == WORD
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, starts
    lengths = np.add.reduceat(inside, starts).astype(np.int64)
    return run_hashes(lower[cps], starts, lengths), doc[starts], starts, lengths
