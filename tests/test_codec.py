import gzip

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec

CASES = {
    "gzip": (gzip.compress("é 😀".encode()), "é 😀", "é 😀", "é 😀"),
    "two members": (gzip.compress(b"ab") + gzip.compress(b"cd"), "abcd", "abcd", "abcd"),
    "plain": (b"plain", "", "plain", "plain"),
    "bad gzip": (b"\x1f\x8bnot gzip", "", "\x1f�not gzip", "\x1f�not gzip"),
    "gzip of bad text": (gzip.compress(b"a\xffb"), "", "a�b", "a�b"),
    "bad text": (b"a\xe2\x82b", "", "a�b", "a�b"),
    "empty": (b"", "", "", ""),
    "missing": (None, "", "", ""),
}


def test_decoders(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name STRING, data BINARY")
    data = F.col("data")
    rows = df.select("name", codec.decode_body(data), codec.decode_lenient(data), codec.decode_response(data)).collect()
    for name, *got in rows:
        assert tuple(got) == CASES[name][1:], name


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(min_size=1), min_size=1, max_size=50))
def test_round_trip(spark, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    back = df.select("t", codec.decode_body(codec.encode_gzip(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in back)


def test_no_body_is_stored_as_null(spark):
    df = spark.createDataFrame([("",), (None,)], "t STRING")
    assert [r[0] for r in df.select(codec.encode_gzip(F.col("t"))).collect()] == [None, None]
