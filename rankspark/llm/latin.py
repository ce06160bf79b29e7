"""Character classes of the Latin blocks for the standard library's fast patterns.

Below U+0250, letters and numbers are the same in every Unicode version in use; texts with characters beyond that (but
for common punctuation) need a pattern engine with full properties.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

LAST = 0x24F


def _ranges(test: Callable[[str], bool]) -> str:
    """Characters up to LAST that pass, as ranges of a character class."""
    ranges: list[list[int]] = []
    for c in range(LAST + 1):
        if test(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


LETTERS = _ranges(lambda c: unicodedata.category(c)[0] == "L")
NUMBERS = _ranges(lambda c: unicodedata.category(c)[0] == "N")
SPACES = r"\t-\r \x85\xa0"
#: A character that the classes above don't settle, or whose lower-case form they don't.
BEYOND = re.compile(f"[^{_ranges(lambda c: max(c.lower()) <= chr(LAST))}\\u2010-\\u2027]")
