"""The stored minute aggregate of slots, kept up by its touched minutes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import time_bucket
from tallyflow.operators.health import health_of
from tallyflow.sources import writers

VIEW = "slot_health_1m"


def refresh(rows: DataFrame, root: str) -> int:
    """Recompute the minutes of ``rows`` (slot rows just stored) from the stored slots; the number of minutes.

    Days that ``rows`` does not touch are neither read nor written, and of touched days
    the other minutes keep their rows. It reads what is stored, so it can be repeated.
    """
    spark = rows.sparkSession
    minutes = rows.select(time_bucket(F.col("timestamp"), "minute").cast(rows.schema["timestamp"].dataType).alias("minute")).where("minute IS NOT NULL").distinct()
    with writers.staging(spark) as staged:
        touched = staged(writers.with_bucket(minutes.withColumnRenamed("minute", "timestamp"), VIEW))
        days = writers.bucket_rows(touched)
        names = list(days)
        stored = writers.read_folders(spark, f"{root}/slots", names=names)
        if stored is None:
            return 0
        kind = stored.schema["timestamp"].dataType
        wanted = touched.select(F.col("timestamp").cast(kind).alias("minute"))
        own = stored.withColumn("minute", time_bucket(F.col("timestamp"), "minute").cast(kind)).join(wanted, "minute", "left_semi")
        fresh = health_of(own, "minute").withColumnRenamed("bucket", "timestamp")
        # as many rows as minutes at most
        fresh = writers.in_folders(writers.with_bucket(fresh, VIEW), writers.shared_months(spark, f"{root}/{VIEW}", VIEW, days))
        there = writers.read_folders(spark, f"{root}/{VIEW}", names=names, schema=fresh.schema)
        if there is not None:
            fresh = fresh.unionByName(there.join(wanted.withColumnRenamed("minute", "timestamp"), "timestamp", "left_anti").select(*fresh.columns))
        fresh = staged(fresh)
        left = writers.bucket_rows(fresh)
        if left:
            writers.write_buckets(fresh, f"{root}/{VIEW}", VIEW, "overwrite", left)
        # most days without such a minute have no folder to drop, and each call takes its time
        for name in writers.overlapping(writers.folders(spark, f"{root}/{VIEW}"), names) - left.keys():
            writers.drop_folder(spark, f"{root}/{VIEW}", "bucket", name)
        return wanted.count()


def stored_health(spark: SparkSession, root: str, as_of: Column, lookback: str = "1 hour") -> DataFrame:
    """Minutes newer than ``as_of - lookback``, in the columns of ``health.slot_health``; only days that can hold some are read."""
    since = spark.range(1).select((as_of - F.expr(f"INTERVAL {lookback}")).cast("string")).first()[0]
    have = sorted(writers.folders(spark, f"{root}/{VIEW}"))
    if not have:
        raise ValueError(f"no minute view is stored under {root}")
    # the newest day is read in any case, for the schema
    found = writers.read_folders(spark, f"{root}/{VIEW}", names=[n for n in have if n == have[-1] or since[: len(n[:10])] <= n[:10]])
    kind = found.schema["timestamp"].dataType
    return found.where(F.col("timestamp") > F.lit(since).cast(kind)).select(F.col("timestamp").alias("bucket"), "slot_count", "skipped_slots", "skip_rate", "slots_per_second")
