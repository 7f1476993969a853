"""Sketches by time bucket that add up over any period: quantiles of lags, distinct accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import lag_millis, time_bucket

#: Size of a quantile sketch. Of n values the rank of a quantile is off by more than ``RANK_ERROR`` times n
#: in one case of a hundred (the family's published bound: about 2.3 / k ** 0.97 for one rank).
KLL_K, RANK_ERROR = 1024, 0.004
#: Bits of a distinct sketch's buckets: one standard error is 0.8 per cent.
HLL_BITS, DISTINCT_ERROR = 14, 0.03


def _bucket(df: DataFrame, unit: str, time: str) -> Column:
    return time_bucket(F.col(time), unit).cast(df.schema[time].dataType).alias("timestamp")


def lag_sketches(rows: DataFrame, unit: str = "hour", block_time: str = "block_time", indexed: str = "observed_at", by: Sequence[str] = ()) -> DataFrame:
    """(timestamp, *by, lags, sketch) of the milliseconds from block to index, in buckets of arrival; rows without a block time have no lag.

    A sketch has a fixed size and is filled before the shuffle.
    """
    lag = rows.select(*by, _bucket(rows, unit, indexed), lag_millis(F.col(indexed), F.col(block_time)).alias("lag")).where("lag IS NOT NULL")
    return lag.groupBy("timestamp", *by).agg(F.count(F.lit(1)).alias("lags"), F.kll_sketch_agg_bigint("lag", F.lit(KLL_K)).alias("sketch"))


def merged_lags(sketches: DataFrame, probabilities: Sequence[float], unit: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Quantiles over all buckets of a longer unit (none: over all there are), from the sketches alone."""
    keys = [*by, *([_bucket(sketches, unit, "timestamp")] if unit else [])]
    merged = sketches.groupBy(*keys).agg(F.sum("lags").alias("lags"), F.kll_merge_agg_bigint("sketch", F.lit(KLL_K)).alias("sketch"))
    return merged.select(*[c for c in merged.columns if c != "sketch"], *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias(f"lag_p{round(100 * p)}_ms") for p in probabilities])


def account_sketches(rows: DataFrame, unit: str = "hour", key: str = "pubkey", by: Sequence[str] = ("owner",), time: str = "timestamp") -> DataFrame:
    """(timestamp, *by, updates, sketch) of the distinct keys of each bucket."""
    return rows.groupBy(_bucket(rows, unit, time), *by).agg(F.count(F.lit(1)).alias("updates"), F.hll_sketch_agg(key, F.lit(HLL_BITS)).alias("sketch"))


def merged_accounts(sketches: DataFrame, unit: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(timestamp, *by, updates, accounts): distinct keys over longer buckets, and over whatever ``by`` leaves out."""
    keys = [*by, *([_bucket(sketches, unit, "timestamp")] if unit else [])]
    merged = sketches.groupBy(*keys).agg(F.sum("updates").alias("updates"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("accounts", F.hll_sketch_estimate("sketch")).drop("sketch")
