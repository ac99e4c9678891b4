"""Case and white space by one character at a time, as DuckDB has them: Spark's change lengths and look at neighbours."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of regular expressions (Java's has the vertical tab too), and what trimming takes off: all of Unicode's spaces.
WHITE = r"[\t\n\f\r ]+"
SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def _upper(c: str) -> str:
    return "ẞ" if c == "ß" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)


def _lower(c: str) -> str:
    return c.lower()[0]


@cache
def _moved(simple: Callable[[str], str]) -> tuple[str, str]:
    """The characters that ``simple`` changes, and what they become."""
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    both = [(c, simple(c)) for c in every if simple(c) != c]
    return "".join(c for c, _ in both), "".join(x for _, x in both)


def _cased(text: Column, fast: Callable[[Column], Column], simple: Callable[[str], str]) -> Column:
    return F.when(F.octet_length(text) == F.length(text), fast(text)).otherwise(F.translate(text, *_moved(simple)))


def simple_upper(text: Column) -> Column:
    """Each character's own capital: the sharp s becomes its capital and not SS."""
    return _cased(text, F.upper, _upper)


def simple_lower(text: Column) -> Column:
    """Each character's own small letter: a final sigma is like any other."""
    return _cased(text, F.lower, _lower)


def trim_spaces(text: Column) -> Column:
    """Without any of SPACES at both ends; line ends and tabs stay."""
    return F.btrim(text, F.lit(SPACES))
