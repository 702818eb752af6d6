"""Fill-in-middle: two cuts at unit boundaries, found in a Roaring-style boundary set.

The set of a text holds the byte offsets at which a cut may fall: before, between and behind its
units. It is kept in containers of 65,536 offsets, each the smallest of a sorted array, a bitmap
and a list of runs, with the cumulative cardinalities beside them. The k-th boundary is found by
a search for its container and a select inside it, so a text of any length needs one pass and
memory for one container's mask at a time.

Units are code points, or what a pattern matches, left to right; text that no match covers is a
unit of its own. NULL text counts as empty. An empty text, a text that holds one of the marks,
and the share of texts that the draw leaves alone stay plain: the output is the text. The draws
depend on ``seed`` and the key alone, so equal keys are cut alike; a NULL key draws as an empty
one. Rows are independent: repeated rows, extra columns and empty tables pass through; a column
of the name of a result is replaced.
"""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = 1 << 16
BLOCK = 512


class Marks(NamedTuple):
    """What stands before prefix, suffix and middle. A mark's first character stands nowhere else in a
    mark and no mark begins another, so the first place where a mark is found is where it was put."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Marks:
        firsts = {mark[:1] for mark in self}
        if "" in firsts or any(c in firsts for mark in self for c in mark[1:]):
            raise ValueError("a mark's first character must stand nowhere else in a mark")
        if any(a != b and b.startswith(a) for a in self for b in self) or len(set(self)) < len(self):
            raise ValueError("marks must differ and none may begin another")
        return self


MARKS = Marks()


class _Array:
    kind = "array"

    def __init__(self, mask: np.ndarray):
        self.low = np.flatnonzero(mask).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Bitmap:
    kind = "bitmap"

    def __init__(self, mask: np.ndarray):
        whole = np.zeros(SPAN, bool)
        whole[: len(mask)] = mask
        self.bits = np.packbits(whole)
        self.before = np.concatenate([[0], np.cumsum(whole.reshape(-1, BLOCK).sum(axis=1))])

    def select(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.unpackbits(self.bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(inside)[k - self.before[block]])


class _Runs:
    kind = "runs"

    def __init__(self, edges: np.ndarray):
        self.starts, ends = edges[::2], edges[1::2]
        self.before = np.concatenate([[0], np.cumsum(ends - self.starts)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run] + k - self.before[run])


def _container(mask: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest of the three for one span."""
    count = int(np.count_nonzero(mask))
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    sizes = {"runs": 2 * len(edges), "array": 2 * count, "bitmap": SPAN // 8}
    best = min(sizes, key=sizes.get)
    return _Runs(edges) if best == "runs" else _Array(mask) if best == "array" else _Bitmap(mask)


class BoundarySet:
    """Ascending offsets with ``select``; filled span by span from masks."""

    def __init__(self) -> None:
        self.bases: list[int] = []
        self.containers: list[_Array | _Bitmap | _Runs] = []
        self.before = [0]

    def add(self, base: int, mask: np.ndarray) -> None:
        count = int(np.count_nonzero(mask))
        if count:
            self.bases.append(base)
            self.containers.append(_container(mask))
            self.before.append(self.before[-1] + count)

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.bases[at] + self.containers[at].select(k - self.before[at])


def code_points(data: bytes) -> BoundarySet:
    """Byte offsets where code points of UTF-8 begin, and the end."""
    found, size = BoundarySet(), len(data)
    raw = np.frombuffer(data, np.uint8)
    for base in range(0, size + 1, SPAN):
        mask = (raw[base : base + SPAN] & 0xC0) != 0x80
        if size - base < SPAN:
            mask = np.append(mask, True)
        found.add(base, mask)
    return found


def units(data: bytes, pattern: str) -> BoundarySet:
    """Byte offsets around the matches of a pattern."""
    text = data.decode("utf-8", "replace")
    starts = code_points(data)
    places = sorted({0, len(text)}.union(*(m.span() for m in re.finditer(pattern, text))))
    offsets = np.array([starts.select(p) for p in places])
    found = BoundarySet()
    for base in range(0, len(data) + 1, SPAN):
        mask = np.zeros(min(SPAN, len(data) + 1 - base), bool)
        mask[offsets[np.searchsorted(offsets, base) : np.searchsorted(offsets, base + SPAN)] - base] = True
        found.add(base, mask)
    return found


def cuts(text: Column, first: Column, second: Column, pattern: str | None = None) -> Column:
    """STRUCT<n, low, high, low_byte, high_byte>: number of units, the two cuts in units, and in bytes.

    ``first`` and ``second`` are draws; each is taken modulo n + 1.
    """

    def find(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        rows = []
        for data, a, b in zip(texts, firsts, seconds, strict=True):
            bounds = code_points(data) if pattern is None else units(data, pattern)
            low, high = sorted((a % len(bounds), b % len(bounds)))
            rows.append((len(bounds) - 1, low, high, bounds.select(low), bounds.select(high)))
        return pd.DataFrame(rows, columns=["n", "low", "high", "low_byte", "high_byte"], dtype="int64")

    find.__annotations__ = {"texts": pd.Series, "firsts": pd.Series, "seconds": pd.Series, "return": pd.DataFrame}
    kind = "n BIGINT, low BIGINT, high BIGINT, low_byte BIGINT, high_byte BIGINT"
    return F.pandas_udf(find, kind)(F.encode(text, "utf-8"), first, second)


def draw(key: Column, number: int, seed: int = 1) -> Column:
    """The number-th (from 1) 32-bit draw of a key: eight hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("bigint")


def has_mark(text: Column, marks: Marks = MARKS) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def transform(
    df: DataFrame, key: str, text: str = "text", seed: int = 1, keep_plain: int = 10, suffix_first: int = 20,
    marks: Marks = MARKS, pattern: str | None = None,
) -> DataFrame:
    """Add n, form, low, high (the cuts, in units; NULL for plain) and output.

    ``keep_plain`` and ``suffix_first`` are percentages: of all texts, and of those that are cut.
    Form psm is prefix, suffix, middle; spm puts the suffix first.
    """
    marks.checked()
    whole = text_of(text)
    plain = (whole == "") | has_mark(whole, marks) | (draw(F.col(key), 3, seed) % 100 >= 100 - keep_plain)
    form = F.when(plain, "plain").when(draw(F.col(key), 4, seed) % 100 < suffix_first, "spm").otherwise("psm")
    rows = df.withColumns({"_infill_cut": cuts(whole, draw(F.col(key), 1, seed), draw(F.col(key), 2, seed), pattern), "form": form})
    data = F.encode(whole, "utf-8")

    def part(start: Column, end: Column) -> Column:
        return F.decode(F.substring(data, (start + 1).cast("int"), (end - start).cast("int")), "utf-8")

    low, high = F.col("_infill_cut.low_byte"), F.col("_infill_cut.high_byte")
    prefix, middle = part(F.lit(0), low), part(low, high)
    suffix = part(high, F.octet_length(whole).cast("bigint"))
    psm = F.concat(F.lit(marks.prefix), prefix, F.lit(marks.suffix), suffix, F.lit(marks.middle), middle)
    spm = F.concat(F.lit(marks.suffix), suffix, F.lit(marks.prefix), prefix, F.lit(marks.middle), middle)
    is_plain = F.col("form") == "plain"
    return rows.withColumns(
        {
            "n": F.col("_infill_cut.n"), "low": F.when(~is_plain, F.col("_infill_cut.low")), "high": F.when(~is_plain, F.col("_infill_cut.high")),
            "output": F.when(is_plain, whole).when(F.col("form") == "psm", psm).otherwise(spm),
        }
    ).drop("_infill_cut")


def restore(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text that ``transform`` was given, from its output and form."""
    first = F.when(form == "psm", F.lit(marks.prefix)).otherwise(marks.suffix)
    second = F.when(form == "psm", F.lit(marks.suffix)).otherwise(marks.prefix)
    one, two, three = F.length(first), F.length(second), len(marks.middle)
    end = F.length(output)
    at = F.instr(output, second)
    left = F.substring(output, one + 1, at - one - 1)
    rest = F.substring(output, at + two, end)
    cut = F.instr(rest, F.lit(marks.middle))
    right, middle = F.substring(rest, F.lit(1), cut - 1), F.substring(rest, cut + three, end)
    whole = F.when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
    return F.when(form == "plain", output).otherwise(whole)
