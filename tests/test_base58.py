"""Base58 of whole batches against plain big integers."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallyflow.functions import base58
from tallyflow.functions import columns as c

RAW = st.one_of(st.none(), st.builds(lambda z, r: bytes(z) + r, st.integers(0, 5), st.binary(max_size=70)), st.binary(min_size=32, max_size=32), st.binary(min_size=129, max_size=200))
TEXT = st.one_of(st.none(), st.text(alphabet=base58.BASE58, max_size=95), st.text(alphabet=base58.BASE58 + "0OIl é", max_size=50), st.text(alphabet="1", max_size=40), st.text(alphabet="z1", min_size=40, max_size=140))


@settings(max_examples=150, deadline=None)
@given(st.lists(RAW, max_size=30))
def test_encode_equals_big_integers(raws):
    wanted = [None if r is None else base58.encode_one(r) for r in raws]
    assert base58.encode(pa.array(raws, pa.binary())).to_pylist() == wanted
    assert base58.decode(pa.array(wanted, pa.string())).to_pylist() == raws


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=30))
def test_decode_equals_big_integers(texts):
    wanted = [None if t is None else base58.decode_one(t) for t in texts]
    assert base58.decode(pa.array(texts, pa.string())).to_pylist() == wanted
    assert base58.decode(pa.array([*texts, "x"], pa.string()).slice(0, len(texts))).to_pylist() == wanted


@given(st.lists(st.one_of(st.none(), st.lists(RAW, max_size=4)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_lists(lists):
    array = pa.array([*lists, [b"x"]], pa.list_(pa.binary())).slice(0, len(lists))
    assert base58.each(base58.encode, array).to_pylist() == [None if x is None else [None if r is None else base58.encode_one(r) for r in x] for x in lists]


def test_columns(spark):
    rows = [(None, None), (b"", ""), (bytes(32), "1" * 32), (b"\0\xff" * 16, "0x"), (b"abc", "  "), (bytes(range(32)), " " + c.key_text(bytes(range(32))) + "\t")]
    df = spark.createDataFrame(rows, "raw binary, text string").select(
        "raw", "text", c.base58_encode(F.col("raw")).alias("e"), c.base58_encode_each(F.array("raw", F.lit(b"z"))).alias("es"), c.base58_decode("text").alias("d"), c.base58_decode_each(F.array("text")).alias("ds"),
        c.key_bytes_of(F.col("text")).alias("k"), c.checked_key("text").alias("checked"),
    )
    for r in df.collect():
        raw, text = None if r.raw is None else bytes(r.raw), r.text
        assert r.e == (None if raw is None else base58.encode_one(raw)) and r.es == [r.e, base58.encode_one(b"z")]
        plain = None if text is None else base58.decode_one(text)
        assert (None if r.d is None else bytes(r.d)) == plain and [None if x is None else bytes(x) for x in r.ds] == [plain]
        assert (None if r.k is None else bytes(r.k)) == (None if text is None else c.key_bytes(text))
        trimmed = (text or "").strip()
        good = base58.decode_one(trimmed) if trimmed else None
        reason = "empty" if not trimmed else "not base58" if good is None else None if len(good) == 32 else f"{len(good)} bytes, not 32"
        assert r.checked.reason == reason and (r.checked.bytes is None) == (reason is not None)


@pytest.mark.parametrize("n", [0, 3])
def test_empty_batches(n):
    assert base58.encode(pa.nulls(n, pa.binary())).to_pylist() == [None] * n
    assert base58.decode(pa.nulls(n, pa.string())).to_pylist() == [None] * n
    assert base58.each(base58.decode, pa.nulls(n, pa.list_(pa.string()))).to_pylist() == [None] * n


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=20, deadline=None)
def test_what_can_be_read_is_known_from_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, "", "abc\n", "l", None]], "text string")
    for r in df.select("text", c.is_base58(F.col("text")).alias("can")).collect():
        assert r.can is (None if r.text is None else base58.decode_one(r.text) is not None)


def test_an_item_that_comes_often_is_converted_once():
    sizes = []
    lists = pa.array([[b"a", b"b", None], None, [b"a"] * 50, [], [b"b", b"c"]], pa.list_(pa.binary()))
    got = base58.each(lambda x: sizes.append(len(x)) or base58.encode(x), lists)
    assert sizes == [3]
    assert got.to_pylist() == [None if x is None else [None if r is None else base58.encode_one(r) for r in x] for x in lists.to_pylist()]
