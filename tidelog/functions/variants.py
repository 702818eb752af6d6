"""Reading schema-less JSON as VARIANT: parse once, then project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_line


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def looks_like_object(text: Column) -> Column:
    return F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))


def parse_stripped(text: Column) -> Column:
    """JSON object as VARIANT from text without white space around it; else NULL.

    The parser tolerates text after the value, so the braces are checked too.
    """
    return F.when(looks_like_object(text), F.try_parse_json(text))


def parse_object(text: Column) -> Column:
    """JSON object as VARIANT; NULL for anything else."""
    return bind(strip_line(text), parse_stripped)


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def text_of(value: Column, path: str) -> Column:
    return get(value, path, "string")


def items(value: Column, path: str = "") -> Column:
    """Array elements; NULL when the value is no array."""
    return get(value, path, "array<variant>")


def entries(value: Column, path: str = "") -> Column:
    """Object as a map; NULL when the value is no object."""
    return get(value, path, "map<string,variant>")


def is_object(value: Column) -> Column:
    return entries(value).isNotNull()


def has_key(value: Column, path: str, key: str) -> Column:
    """Key present, even if its value is null."""
    return F.coalesce(F.array_contains(F.map_keys(entries(value, path)), key), F.lit(False))


# JSON texts of the values that count as nothing.
EMPTY_JSON = ("null", "[]", "{}", '""', "0", "false")


def truthy(value: Column, path: str) -> Column:
    """Present and not empty, zero or false. A look at the first element settles the
    usual case, an array, without copying it."""
    has_first = get(value, f"{path}[0]", "variant").isNotNull()
    other = ~F.to_json(get(value, path, "variant")).isin(*EMPTY_JSON)
    return F.coalesce(has_first | other, F.lit(False))


def plain_string(value: Column) -> Column:
    """The value if it is a JSON string, else NULL."""
    scalar = items(value).isNull() & entries(value).isNull()
    return F.when(
        scalar & (F.schema_of_variant(value) == "STRING"), F.try_variant_get(value, "$", "string")
    )
