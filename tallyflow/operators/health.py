"""Network health by time bucket, and the stress summary over the newest buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import stress_level, time_bucket

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _measures(seconds: int) -> list[Column]:
    skipped = F.sum(F.col("slot") - F.col("parent_slot") - 1)
    count = F.count(F.lit(1))
    return [
        count.alias("slot_count"), skipped.alias("skipped_slots"),
        F.try_divide(skipped.cast("double"), F.nullif((count + skipped).cast("double"), F.lit(0.0))).alias("skip_rate"),
        (count / F.lit(float(seconds))).alias("slots_per_second"),
    ]


def slot_health(slots: DataFrame, as_of: Column, lookback: str = "1 hour", bucket: str = "minute", status: str = "finalized") -> DataFrame:
    """Counts and rates of each bucket of slots newer than ``as_of - lookback``.

    A slot without parent counts but skips nothing; a bucket whose parents are
    all missing has a null rate; first and last buckets are divided by the whole
    unit like the others.
    """
    kind = slots.schema["timestamp"].dataType
    return health_of(slots.where(F.col("timestamp") > (as_of - F.expr(f"INTERVAL {lookback}")).cast(kind)), bucket, status)


def health_of(slots: DataFrame, bucket: str = "minute", status: str = "finalized") -> DataFrame:
    """The same of all slots."""
    kind = slots.schema["timestamp"].dataType
    return slots.where(F.col("status") == status).groupBy(time_bucket(F.col("timestamp"), bucket).cast(kind).alias("bucket")).agg(*_measures(SECONDS[bucket]))


def slot_health_stream(slots: DataFrame, watermark: str = "1 hour", bucket: str = "minute", status: str = "finalized") -> DataFrame:
    """The same by tumbling windows on a stream; rows later than the watermark are dropped."""
    timed = slots.where(F.col("status") == status).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    grouped = timed.groupBy(F.window("timestamp", f"1 {bucket}").alias("w")).agg(*_measures(SECONDS[bucket]))
    return grouped.select(F.col("w.start").alias("bucket"), "slot_count", "skipped_slots", "skip_rate", "slots_per_second")


def newest_buckets(health: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` buckets with their stress level; nulls read as 0."""
    zero = health.select("bucket", "slot_count", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("skipped_slots", "long"), ("skip_rate", "double"), ("slots_per_second", "double"))])
    return zero.orderBy(F.desc("bucket")).limit(n).withColumn("stress_level", stress_level(F.col("skip_rate")))


def network_stress(health: DataFrame, n: int = 30) -> DataFrame:
    """One row: current rate and speed, totals over the newest ``n`` buckets, level; zeros and ``normal`` without buckets."""
    latest = F.max_by(F.struct("skip_rate", "slots_per_second"), "bucket")
    one = newest_buckets(health, n).agg(
        latest.alias("now"), F.sum("skipped_slots").alias("skipped"), F.sum("slot_count").alias("total"),
        F.array_sort(F.collect_list(F.struct("bucket", "slot_count", "skipped_slots", "skip_rate", "slots_per_second"))).alias("buckets"),
    )
    rate = F.coalesce("now.skip_rate", F.lit(0.0))
    return one.select(
        rate.alias("slot_skip_rate"), F.coalesce("now.slots_per_second", F.lit(0.0)).alias("slots_per_second"), F.coalesce("skipped", F.lit(0).cast("long")).alias("skipped_slots_1h"),
        F.coalesce("total", F.lit(0).cast("long")).alias("total_slots_1h"), stress_level(rate).alias("stress_level"), F.reverse("buckets").alias("buckets"),
    )
