"""Characters of texts as arrays of code points, and what each code point is."""

from __future__ import annotations

from functools import cache

import numpy as np

DOTTED, DOT_ABOVE = 0x130, 0x307  # the one letter whose lower case is two


@cache
def lower() -> np.ndarray:
    """The lower case of each code point, by itself."""
    return np.fromiter((ord(chr(i).lower()[0]) for i in range(0x110000)), np.uint32, 0x110000)


@cache
def space() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


@cache
def word() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() or i == 0x5F for i in range(0x110000)), bool, 0x110000)


@cache
def letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
