"""Letter, number and space classes as the tokenizers library sees them."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex

#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def classes() -> bytes:
    """A class for each code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = bytearray([OTHER]) * 0x110000
    for pattern, kind in (("\\p{L}+", LETTER), ("\\p{N}+", NUMBER), ("\\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = bytes([kind]) * (b + 1 - a)
    return bytes(out)


@functools.cache
def _disputed() -> np.ndarray:
    table = np.frombuffer(classes(), np.uint8)
    flags = np.zeros(0x110000, bool)
    for c in np.flatnonzero((table == LETTER) | (table == NUMBER)).tolist():
        flags[c] = unicodedata.category(chr(c)) == "Cn"
    return flags


def disputed() -> list[int]:
    """Letters and numbers that this Python's Unicode tables leave unassigned.

    Libraries with other Unicode versions may class them otherwise, so texts that
    hold one take the library's own, slower path.
    """
    return np.flatnonzero(_disputed()).tolist()


def has_disputed(text: str) -> bool:
    try:
        text.encode("latin-1")  # none there, and this is fast
    except UnicodeEncodeError:
        return bool(_disputed()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())
    return False
