"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut at empty lines into sections and at line ends into paragraphs, without loss. A
paragraph's digest is the SHA-256 of its text, a section's that of its paragraphs' digests, the
root's that of the sections' digests. Equal roots mean equal texts; where roots differ, only
branches that differ are looked into, and the paragraphs found there are the places of the edit.

The leaves below the paragraphs are runs of words. Where a run ends is decided by its own words (a
mark or one of a few letters at a word's end), so behind an insertion the same runs are found
again. A leaf's code is 33 bits of hash and 7 of length. A fingerprint is the root and a sketch of
the leaves: the SKETCH lowest codes, each with the number of times it stands in the text. It is
below 4 kB for any text, and whole for texts of up to SKETCH different leaves.

Two fingerprints are compared from the root down. Equal roots end it: likeness 1. Else the leaves
are compared (those of equal branches are equal): up to the code to which both sketches reach,
twice the weight they share, counted as often as both have it, over the weight of both. With
larger texts this is an estimate over SKETCH leaves, off by about 0.04.

Everything is column expressions. Defined cases: NULL text is the empty text, one empty section;
equal texts have likeness 1, also empty ones; repeated rows and extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, unit

# marks of unspaced scripts; behind them a word ends, as before white space and after 40 characters
MARKS = "、-。！-？"
WORD = rf"(?:[\S&&[^{MARKS}]]{{1,40}}+[{MARKS}]*+|[{MARKS}]++)"
# three words, then up to the next word that ends a leaf, at most ten more
LEAF = rf"\s++|(?:{WORD}\s*+){{1,3}}+(?:{WORD}(?<=[^.,;:!?dnty0-9{MARKS}])\s*+){{0,9}}+(?:{WORD}\s*+)?+"
SKETCH = 192
SLICES = 4096
BUCKET_ROWS = 512
GROUP = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; lambdas compute other columns for every element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _code(piece: Column) -> Column:
    low = F.xxhash64(piece).bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(low, 7).bitwiseOR(F.least(F.length(piece), F.lit(127)).cast("bigint"))


def tree(text: Column) -> Column:
    """ARRAY of sections, each an ARRAY of paragraphs STRUCT<digest, codes>."""
    paragraph = lambda p: F.struct(
        F.sha2(p, 256).alias("digest"), F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), _code).alias("codes")
    )
    return F.transform(F.split(text, "\n\n"), lambda section: F.transform(F.split(section, "\n"), paragraph))


def outline(text: Column) -> Column:
    """The tree without its leaves: ARRAY of sections, each an ARRAY of paragraphs STRUCT<digest>."""
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("digest"))
    return F.transform(F.split(text, "\n\n"), lambda section: F.transform(F.split(section, "\n"), paragraph))


def _section(paragraphs: Column) -> Column:
    return F.sha2(F.array_join(F.transform(paragraphs, lambda p: p["digest"]), ""), 256)


def root(nodes: Column) -> Column:
    """The digest of the whole text, from a tree."""
    return F.sha2(F.array_join(F.transform(nodes, _section), ""), 256)


def codes(nodes: Column) -> Column:
    """The lowest leaf codes of a tree with their numbers: ARRAY of STRUCT<code, n>, by code.

    At most SKETCH + 1; of an array that long the last is not compared, it only says how far the
    sketch reaches.
    """
    every = F.sort_array(F.flatten(F.transform(nodes, lambda s: F.flatten(F.transform(s, lambda p: p["codes"])))))

    def counted(found: Column) -> Column:
        borders = F.transform(found, lambda c, i: F.when((i == 0) | (c != F.get(found, i - 1)), i))
        borders = F.slice(F.filter(borders, lambda i: i.isNotNull()), 1, SKETCH + 2)
        entry = lambda starts: lambda i, k: F.struct(
            F.get(found, i).alias("code"), (F.coalesce(F.get(starts, k + 1), F.size(found)) - i).alias("n")
        )
        return F.slice(_let(borders, lambda starts: F.transform(starts, entry(starts))), 1, SKETCH + 1)

    return _let(every, counted)


def mark(nodes: Column) -> Column:
    """STRUCT<root, codes>: all that a comparison needs."""
    return F.struct(root(nodes).alias("root"), codes(nodes).alias("codes"))


def shown(found: Column) -> Column:
    """A mark as text: the root, '/', then 10 digits of each code and 7 of its number."""
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    leaves = F.transform(found["codes"], lambda c: F.concat(hexed(c["code"], 10), hexed(c["n"], 7)))
    return F.concat(found["root"], F.lit("/"), F.array_join(leaves, ""))


def fingerprint(nodes: Column) -> Column:
    """The fingerprint of a tree as text."""
    return _let(mark(nodes), shown)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of the leaf codes of two trees."""
    reach = lambda x: F.get(x, F.lit(SKETCH))["code"]  # noqa: E731  NULL: the sketch is whole
    upto = lambda x, edge: F.filter(x, lambda c: edge.isNull() | (c["code"] < edge))
    names = lambda x: F.transform(x, lambda c: c["code"])
    length = lambda c: c["code"].bitwiseAND(F.lit(127))
    total = lambda weights: F.aggregate(weights, F.lit(0).cast("bigint"), lambda s, w: s + w)

    def compared(both: Column) -> Column:
        a, b = both["a"], both["b"]
        # entries of the codes that both have are in the same order on both sides
        of = lambda x, common: F.filter(x, lambda c: F.array_contains(common, c["code"]))
        shared = _let(F.array_intersect(names(a), names(b)), lambda common: total(
            F.zip_with(of(a, common), of(b, common), lambda x, y: F.least(x["n"], y["n"]) * length(x))))
        weight = total(F.transform(F.concat(a, b), lambda c: c["n"] * length(c)))
        return F.when(weight == 0, F.lit(1.0)).otherwise(2.0 * shared / weight)

    edge = F.least(reach(a), reach(b))  # skips NULL
    return _let(F.struct(a.alias("a"), b.alias("b"), edge.alias("edge")), lambda x: _let(
        F.struct(upto(x["a"], x["edge"]).alias("a"), upto(x["b"], x["edge"]).alias("b")), compared))


def alike(a: Column, b: Column) -> Column:
    """0 to 1, of two marks: equal roots are 1, others are compared by their leaves."""
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(likeness(a["codes"], b["codes"]))


def first_edit(a: Column, b: Column) -> Column:
    """STRUCT<section, paragraph> where tree or outline ``b`` first differs from ``a``, from 0; NULL if nowhere.

    The first section whose digest differs is looked into, all before it are passed over.
    """
    differs = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True)).cast("int") - 1
    inside = lambda x, s: F.coalesce(F.transform(F.get(x, s), lambda p: p["digest"]), F.array().cast("array<string>"))
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: _let(
        differs(F.transform(x["a"], _section), F.transform(x["b"], _section)),
        lambda s: F.when(s >= 0, F.struct(s.alias("section"), differs(inside(x["a"], s), inside(x["b"], s)).alias("paragraph"))),
    ))


def edits(a: Column, b: Column) -> Column:
    """Paragraphs of tree ``a`` that tree ``b`` lacks: ARRAY of STRUCT<section, paragraph, digest>.

    Sections that ``b`` also has are passed over by their digest alone.
    """
    have = F.transform(b, _section)
    known = F.flatten(F.transform(b, lambda s: F.transform(s, lambda p: p["digest"])))
    place = lambda i: lambda p, j: F.struct(
        i.alias("section"), j.alias("paragraph"), p["digest"].alias("digest")
    )
    lost = lambda s, i: F.filter(F.transform(s, place(i)), lambda x: ~F.array_contains(known, x["digest"]))
    return F.flatten(F.transform(a, lambda s, i: F.when(F.array_contains(have, _section(s)), F.array().cast(
        "array<struct<section:int,paragraph:int,digest:string>>")).otherwise(lost(s, i))))


def _constants(values: Sequence, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _buckets(docs: DataFrame, key: str, text: str) -> tuple[Column, bool]:
    """Number of the bucket of a row: grows with the key, about BUCKET_ROWS rows each; and whether it needs the text.

    The keys' range is cut at SLICES quantiles, the keys at a cut apart from those between two
    cuts, so neither far keys nor a key of many rows widens a bucket. What is still larger is cut
    further: rows of one key (or of NULL, which is below all) by the hash of the text, others
    evenly by the key. Only rows equal in key and text cannot be parted.
    """
    x, kind = F.col(key), docs.schema[key].dataType.simpleString()
    at = [i / SLICES for i in range(1, SLICES)]
    found = docs.agg(F.min(x).alias("low"), F.percentile_approx(x, at, 4 * SLICES).alias("inner"), F.max(x).alias("high")).first()
    cuts = [] if found["low"] is None else sorted({found["low"], *found["inner"], found["high"]})
    edges = _constants(cuts, kind)
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))] or [0]
    # how many cuts are at or below the key, bit by bit
    below = F.aggregate(_constants(steps, "int"), F.lit(0), lambda n, s: F.when(F.get(edges, n + s - 1) <= x, n + s).otherwise(n))
    number = F.when(x.isNull(), F.lit(0)).otherwise(_let(below, lambda n: 2 * n - 1 + (F.get(edges, n - 1) < x).cast("int")))
    # at most 2 * SLICES + 2 rows
    counts = {r["n"]: r["count"] for r in docs.select(number.alias("n")).groupBy("n").count().collect()}
    first, parts, bucket, held = [], [], 0, 0
    for n in range(2 * len(cuts) + 1):
        count = counts.get(n, 0)
        if held and held + count > BUCKET_ROWS:
            bucket, held = bucket + 1, 0
        parts.append(max(1, -(-count // BUCKET_ROWS)))
        first.append(bucket)
        held += count
        if parts[-1] > 1:
            bucket, held = bucket + parts[-1], 0
    one_key = any(p > 1 and (n == 0 or n % 2) for n, p in enumerate(parts))
    firsts, shares = _constants(first, "bigint"), _constants(parts, "int")

    def of(n: Column) -> Column:
        left, right = F.get(edges, F.shiftright(n, 1) - 1), F.get(edges, F.shiftright(n, 1))
        among = (x - left).cast("double") / (right - left).cast("double")
        if one_key:
            among = F.when((n == 0) | (n % 2 == 1), unit(F.col(text))).otherwise(among)
        share = F.get(shares, n)
        inside = F.when(share > 1, F.least(F.floor(among * share), (share - 1).cast("bigint"))).otherwise(F.lit(0))
        return F.get(firsts, n) + inside

    return _let(number, of), one_key


def _followers(heads: DataFrame) -> DataFrame:
    """(head, own bucket, consumer): whose last row is followed by the head's bucket; the last by the first.

    Two levels: neighbours within groups of GROUP buckets, then the groups' edges.
    """
    grouped = heads.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    inside = grouped.withColumn("_above", F.lag("_bucket").over(Window.partitionBy("_group").orderBy(F.desc("_bucket"))))
    edges = grouped.groupBy("_group").agg(F.min("_bucket").alias("_lowest"))
    edges = edges.select(
        "_group",
        F.coalesce(
            F.lag("_lowest").over(Window.orderBy(F.desc("_group"))),
            F.first("_lowest").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("_edge"),
    )
    return inside.join(edges, "_group").select("_head", F.col("_bucket").alias("_own"), F.coalesce("_above", "_edge").alias("_bucket"))


def with_next(docs: DataFrame, derived: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the ``derived`` columns of the text, and ``next_*`` of text and derived columns.

    Next is the next row by descending key (a number; equal keys by text, those of a key that fills
    several buckets by range of the text's hash first); after the last, the first.
    The rows are dealt once, into buckets of the key's range; a bucket's last row is followed by
    the first of the next bucket that has rows. Those first rows are looked up by their keys,
    one narrow row a bucket, landed so that Spark knows their size.
    """
    bucket, by_text = _buckets(docs.select(key, text), key, text)
    names = [text, *derived]
    rows = docs.withColumn("_bucket", bucket).withColumns({name: make(F.col(text)) for name, make in derived.items()})
    keys = docs.select(key, text) if by_text else docs.select(key)
    heads = keys.select(key, bucket.alias("_bucket")).groupBy("_bucket").agg(F.max(key).alias("_head"))
    heads = land(_followers(heads), "bucket-heads")
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), bucket.alias("_at"))
    first = (
        found.join(heads, F.col("_key").eqNullSafe(F.col("_head")) & (F.col("_at") == F.col("_own")))
        .groupBy("_bucket").agg(F.min("_text").alias(f"_first_{text}"))
        .withColumns({f"_first_{name}": make(F.col(f"_first_{text}")) for name, make in derived.items()})
    )
    order = Window.partitionBy("_bucket").orderBy(F.col(key).desc_nulls_last(), text)
    # single columns, so that nothing is copied before the rows are dealt
    rows = rows.withColumns({f"_lead_{name}": F.lead(name).over(order) for name in names})
    return rows.join(first, "_bucket", "left").withColumns(
        {f"next_{name}": F.coalesce(f"_lead_{name}", f"_first_{name}") for name in names}
    ).drop("_bucket", *[f"_{kind}_{name}" for kind in ("lead", "first") for name in names])
