"""Word rules shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII letters and the word patterns that the query contracts name.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TO_LOWER = str.maketrans(UPPER, LOWER)
BYTES_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
ALNUM_RE = re.compile(ALNUM_WORD)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; every other character stays as it is."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of space-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def spaced_words(raw: bytes) -> list[bytes]:
    """bytes.split() cuts at exactly the six white-space bytes of SPACED_WORD."""
    return raw.split()


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the space-separated words of raw begin and end."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]
