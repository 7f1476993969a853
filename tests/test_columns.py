import pytest
from pyspark.sql import functions as F
from tallyflow.functions import columns as c


def one(spark, column, *args):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("rate", "level"),
    [(0.0, "normal"), (0.01, "normal"), (0.02, "elevated"), (0.04, "elevated"), (0.05, "high"), (0.09, "high"), (0.10, "critical"), (0.15, "critical")],
)
def test_stress_level(spark, rate, level):
    assert one(spark, c.stress_level(F.lit(rate))) == level


def test_status_names(spark):
    names = [r[0] for r in spark.range(-1, 8).select(c.status_name(F.col("id"))).collect()]
    assert names == ["unknown", *c.STATUS_NAMES, "unknown"]
    assert one(spark, c.status_name(F.lit(None).cast("int"))) == "unknown"


def test_rates(spark):
    assert one(spark, c.per_second(F.lit(100), F.lit(2.0))) == 50.0
    assert one(spark, c.per_second(F.lit(100), F.lit(0.05))) == 0.0


def test_lag(spark):
    now = F.lit("2024-01-01 00:00:05").cast("timestamp")
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, c.lag_millis(now, then)) == 5000
    assert one(spark, c.lag_millis(then, now)) == 0
    assert one(spark, c.lag_millis(now, F.lit(None).cast("timestamp"))) is None


def test_lists_and_slugs(spark):
    assert one(spark, c.trimmed_list(F.lit(" a, ,b,, c "))) == ["a", "b", "c"]
    assert one(spark, c.slug(F.lit("My Protocol X"))) == "my_protocol_x"
    assert one(spark, c.rfc3339(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05+00:00"


def test_programs_keep_order_and_skip_what_is_out_of_range(spark):
    keys = F.array(*map(F.lit, ["k0", "k1", "k2"]))
    assert one(spark, c.watched_programs(F.array(*map(F.lit, [2, 0, 9, 2, 1])), keys)) == ["k2", "k0", "k1"]


def test_base58_round_trip(spark):
    raw = [b"", b"\0", b"\0\0\1", bytes(range(32)), b"\xff" * 32, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw binary").select("i", "raw", c.base58_encode(F.col("raw")).alias("text"))
    rows = df.select("i", "raw", "text", c.base58_decode("text").alias("back")).orderBy("i").collect()
    assert [None if r.back is None else bytes(r.back) for r in rows] == raw
    assert [r.text for r in rows][:3] == ["", "1", "112"] and rows[5].text is None


def test_checked_keys(spark):
    texts = ["9WzDXwBbmkg8ZTbNMqUxvQRAyrZzDsGYdLVL9zYtAWWM", " 9WzDXwBbmkg8ZTbNMqUxvQRAyrZzDsGYdLVL9zYtAWWM ", "invalid-prog", "9WzDXwBbmkg", "", "   ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, key string").select("i", c.checked_key("key").alias("k")).orderBy("i")
    got = [(None if r.k.bytes is None else len(r.k.bytes), r.k.reason) for r in df.collect()]
    assert got[:3] == [(32, None), (32, None), (None, "not base58")]
    assert got[3][1].endswith("not 32") and [g[1] for g in got[4:]] == ["empty"] * 3
