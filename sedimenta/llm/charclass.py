"""Classes of code points, and texts as arrays of them."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# The code points with the property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def table() -> np.ndarray:
    """The class of every code point, from the Unicode database: letters are L*, numbers N*."""
    first = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)), np.uint8, 0x110000)
    classes = np.zeros(0x110000, np.uint8)
    classes[first == ord("L")] = LETTER
    classes[first == ord("N")] = NUMBER
    classes[WHITE] = SPACE
    return classes


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
