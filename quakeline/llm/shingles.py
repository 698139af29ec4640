"""Sets of five-word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from quakeline.llm.tokens import NOT_SPACE, blocks, lowered, mix, split_words

WORDS = 5
_WEIGHTS = np.random.default_rng(7).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Sequence[str | None], width: int = WORDS) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """For runs of texts their sets: shingles of `width` words; all words as one if fewer; none without words.

    Words stand between ASCII white space (space, 09-0D); A-Z are lower-cased, all else is kept.
    """
    raw = lowered(texts)
    for part in blocks(raw):
        w = split_words(raw[part], NOT_SPACE)
        n = max(0, len(w.hashes) - width + 1)
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s += w.hashes[k : n + k] * _WEIGHTS[k]
        s = mix(s)
        sets = []
        for lo, hi in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
            if hi - lo >= width:
                own = np.sort(s[lo : hi - width + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif hi > lo:
                whole = np.sum(w.hashes[lo:hi] * _WEIGHTS[: hi - lo], dtype=np.uint64)
                sets.append(mix(np.array([whole], np.uint64), 0xA5A5 + hi - lo))
            else:
                sets.append(np.empty(0, np.uint64))
        yield part, sets
