"""Word shingles of whole texts as hashes, and exact comparisons of their sets."""

from __future__ import annotations

import numpy as np

from quarry.llm.vector import group_of, join, prefix_hashes, runs, span_hashes

#: Words in a shingle.
WIDTH = 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash; sorted by both.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer
    than ``width`` words has its whole sequence as its one shingle.
    """
    points, starts = join(texts)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    a, b = runs(~space)
    owner = group_of(a, starts)
    word = span_hashes(prefix_hashes(points), a, b)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    at = np.arange(len(word))
    full = at[(at - first[owner]) + width <= count[owner]] if len(word) else at
    short = np.flatnonzero((count > 0) & (count < width))
    begin = np.concatenate([full, first[short]])
    end = np.concatenate([full + width, first[short] + count[short]])
    who = np.concatenate([owner[full], short])
    hashes = span_hashes(prefix_hashes(word), begin, end)
    order = np.lexsort((hashes, who))
    who, hashes = who[order], hashes[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])]) if len(who) else np.zeros(0, bool)
    return who[new], hashes[new]


def exact_set(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def similar(a: set, b: set, percent: int = 80) -> bool:
    """Whether the Jaccard similarity is at least ``percent``; empty sets are like nothing."""
    if not a or not b:
        return False
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)
