"""Vectorised hashing of words and characters over whole batches of texts.

A text is lower-cased, encoded as UTF-8 and cut into words, the maximal runs of
ASCII letters, digits and non-ASCII bytes. All hashes are 64 bits, are equal on
every machine and depend on the bytes alone. They come from prefix sums of a
polynomial over the bytes, so any substring's hash is a difference of two sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORD[_lo:_hi] = True
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xBF58476D1CE4E5B9)) | U(1)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, U)
        got[0] = 1
        _powers[base] = got = np.cumprod(got, dtype=U)
    return got[:n]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `part` takes the hash of any substring."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def part(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start])


def small(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of few rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class Words:
    """Words of consecutive texts: text i has those from ptr[i] to ptr[i + 1]."""

    first: int
    hashes: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray  # the byte where each text begins


def groups(texts: list, size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as lower-case UTF-8, about `size` bytes at a time; null counts as empty."""
    first, had, group = 0, 0, []
    for i, text in enumerate(texts):
        own = (text or "").encode("utf-8", "replace")
        raw = (text or "").lower().encode("utf-8", "replace")
        if len(raw) != len(own):  # offsets are those of the text as it came
            raw = own.lower()
        if group and had + len(raw) > size:
            yield first, group
            first, had, group = i, 0, []
        group.append(raw)
        had += len(raw)
    if group:
        yield first, group


def words(texts: list) -> Iterator[Words]:
    """The words of all texts, in groups of bounded size unless one text is larger."""
    for first, group in groups(texts):
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, group), np.int64, len(group)) + 1
        begin = np.concatenate(([0], np.cumsum(lengths)))
        change = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=np.int8(0)))
        start, end = change[::2], change[1::2]
        hashes = part(sums(data), start, end) if len(start) else np.zeros(0, U)
        yield Words(first, hashes, np.searchsorted(start, begin), data, start, end, begin)


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words, and the text of each; a text of 1 to n - 1 words is one shorter run."""
    count = np.diff(found.ptr)
    if not len(found.hashes):
        return np.zeros(0, U), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    whole = np.maximum(len(found.hashes) - n + 1, 0)
    total = np.zeros(whole, U)
    for k in range(n):
        total = total * U(_BASE) + found.hashes[k : k + whole]
    full = owner[:whole] == owner[n - 1 :] if whole else np.zeros(0, bool)
    hashes, owners = mix(total[full]), owner[:whole][full]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U)
        for k in range(n - 1):
            at = found.ptr[short] + k
            inside = at < found.ptr[short + 1]
            extra = np.where(inside, extra * U(_BASE) + found.hashes[np.minimum(at, len(found.hashes) - 1)], extra)
        hashes, owners = np.concatenate((hashes, mix(extra + U(1)))), np.concatenate((owners, short))
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners
