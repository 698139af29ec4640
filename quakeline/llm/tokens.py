"""Words of many texts at a time as 64-bit hashes: byte classes and segment sums in numpy, no loop over words.

All word classes used here are decided by single bytes of UTF-8 (bytes from 80 up are always in words), so texts
are scanned as bytes and never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Word bytes of the two tokenisations: all but space and 09-0D; digits, small letters and bytes from 80.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int, seen: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006  (a memory on purpose)
    if len(seen[0]) < n:
        steps = np.full(max(n, 1024), _STEP)
        steps[0] = 1
        seen[0] = np.cumprod(steps, dtype=np.uint64)
    return seen[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser with full avalanche on 64-bit values."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts in order. at: first word of each text and the end; start, end: byte spans in data."""

    hashes: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes
    offsets: np.ndarray


def split_words(texts: Sequence[bytes], word_bytes: np.ndarray) -> Words:
    """Hash the words of texts (already lower-cased as wanted); a separator keeps texts apart."""
    sep = bytes([int(np.flatnonzero(~word_bytes)[-1])])
    data = sep.join(texts) + sep
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    raw = np.frombuffer(data, np.uint8)
    inside = word_bytes[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if len(start):
        length = end - start
        where = np.flatnonzero(inside)
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(len(where)) - np.repeat(first, length)
        hashes = mix(np.add.reduceat(_BYTE[raw[where]] * _powers(int(length.max()))[place], first) + length.astype(np.uint64))
    else:
        hashes = np.empty(0, np.uint64)
    return Words(hashes, np.searchsorted(start, offsets), start, end, data, offsets)


def blocks(texts: Sequence[bytes], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Runs of texts of at most limit bytes together (one text at least)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


def few_rows(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in parts of few rows, so that a worker holds few texts at a time, however large batches are."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def lowered(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
