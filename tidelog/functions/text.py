"""Small string helpers on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped_length(text: Column) -> Column:
    """Characters left when white space, Unicode spaces included, is cut off at both
    ends. Only the ends are matched, so long texts cost little."""
    spaces = r"(?U)^(\s*)"
    before = F.length(F.regexp_extract(text, spaces, 1))
    after = F.length(F.regexp_extract(F.reverse(text), spaces, 1))
    return F.greatest(F.length(text) - before - after, F.lit(0))


def strip_line(line: Column) -> Column:
    """Cheap form of ``strip`` for one line of a protocol."""
    return F.trim(line, F.lit(" \t\r\n\x0b\x0c"))


def json_string(text: Column) -> Column:
    """The JSON literal of a string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def find_ignore_case(text: Column, needle: str) -> Column:
    """1-based position of the first hit, 0 when there is none."""
    return F.coalesce(F.instr(F.lower(text), F.lower(F.lit(needle))), F.lit(0))


def snippet(text: Column, position: Column, needle: str, margin: int = 80) -> Column:
    """The whole hit on one line, with ``margin`` characters to each side."""
    hit = position - 1
    start = F.greatest(F.lit(0), hit - margin)
    piece = F.substring(text, start + 1, hit + len(needle) + margin - start)
    return F.translate(piece, "\t\r\n", "   ")
