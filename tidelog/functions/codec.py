"""Decoding stored bytes.

Spark has no gunzip expression, so (de)compression is the one Arrow UDF of the
library. Only rows that need it travel to Python; other rows stay in the JVM.
The UDFs are marked non-deterministic so that a filter on the decoded text is
not pushed below the projection and the bytes are decoded once.
"""

from __future__ import annotations

import gzip
import importlib.util
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: the functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GZIP_MAGIC = "1F8B"
HAS_BROTLI = importlib.util.find_spec("brotli") is not None


def _gunzip_strict(data: bytes | None) -> str:
    try:
        return gzip.decompress(data).decode("utf-8") if data else ""
    except Exception:
        return ""


def _gunzip_lenient(data: bytes | None) -> str | None:
    """NULL when the bytes are no gzip after all (plain bytes)."""
    try:
        return None if data is None else gzip.decompress(data).decode("utf-8", errors="replace")
    except Exception:
        return None


def _brotli(data: bytes | None) -> str | None:
    """NULL when the bytes are no brotli stream."""
    import brotli

    try:
        return None if data is None else brotli.decompress(data).decode("utf-8", errors="replace")
    except Exception:
        return None


def _pack(text: str | None) -> bytes | None:
    return gzip.compress(text.encode("utf-8"), compresslevel=6, mtime=0) if text else None


def _once(kind: T.DataType):
    return lambda function: F.pandas_udf(function, kind).asNondeterministic()


@_once(T.StringType())
def _gunzip_strict_udf(data: pd.Series) -> pd.Series:
    return data.map(_gunzip_strict)


@_once(T.StringType())
def _gunzip_lenient_udf(data: pd.Series) -> pd.Series:
    return data.map(_gunzip_lenient)


@_once(T.StringType())
def _brotli_udf(data: pd.Series) -> pd.Series:
    return data.map(_brotli)


@_once(T.BinaryType())
def _pack_udf(text: pd.Series) -> pd.Series:
    return text.map(_pack)


def is_gzip(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 2)) == GZIP_MAGIC


def encode_gzip(text: Column) -> Column:
    """Stored form of a request body; NULL when there is none."""
    return _pack_udf(text)


def decode_body(data: Column) -> Column:
    """Strict: anything but gzip of valid UTF-8 gives the empty string."""
    return F.coalesce(_gunzip_strict_udf(F.when(is_gzip(data), data)), F.lit(""))


def decode_lenient(data: Column) -> Column:
    """gzip or plain, bad bytes replaced, NULL gives the empty string."""
    packed = _gunzip_lenient_udf(F.when(is_gzip(data), data))
    return F.coalesce(packed, F.make_valid_utf8(data.cast("string")), F.lit(""))


def decode_response(data: Column) -> Column:
    """gzip, brotli (if installed) or plain, bad bytes replaced. The first bytes tell gzip."""
    found = [_gunzip_lenient_udf(F.when(is_gzip(data), data))]
    if HAS_BROTLI:
        found.append(_brotli_udf(F.when(~is_gzip(data), data)))
    return F.coalesce(*found, F.make_valid_utf8(data.cast("string")), F.lit(""))
