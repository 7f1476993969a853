"""Missing positions, missing and skipped slots, repair status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_seqs(df: DataFrame, low: int, high: int) -> DataFrame:
    """Positions in [low, high) that are not there. For long spans see ``gap_ranges``."""
    return df.sparkSession.range(low, high).withColumnRenamed("id", "seq").join(df.select("seq"), "seq", "left_anti")


def gap_ranges(df: DataFrame, bucket_size: int = 1_000_000) -> DataFrame:
    """(first_missing, last_missing, missing) of each hole between present positions."""
    return interval_gaps(df.select(F.col("seq").alias("low"), F.col("seq").alias("high")), bucket_size)


def interval_gaps(intervals: DataFrame, bucket_size: int = 1_000_000) -> DataFrame:
    """The same of present intervals (low, high), which may touch but not overlap.

    Neighbours are found inside buckets of positions; then between the edges of
    buckets inside buckets of buckets, and so on. No task orders more than
    ``bucket_size`` rows, and each level is smaller by that factor.
    """
    size = max(2, bucket_size)
    low, high = intervals.agg(F.min("low"), F.max("high")).first()
    low, span = low or 0, (high or 0) - (low or 0)
    level = intervals.select("low", "high", F.floor((F.col("low") - low) / size).alias("group"))
    pairs, width = None, size
    while True:
        found = level.select(F.col("high").alias("seq"), F.lead("low").over(Window.partitionBy("group").orderBy("low")).alias("next"))
        pairs = found if pairs is None else pairs.unionByName(found)
        if width > span:
            break
        level = level.groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("group", F.floor(F.col("group") / size))
        width *= size
    holes = pairs.where("next - seq > 1")
    return holes.select((F.col("seq") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"), (F.col("next") - F.col("seq") - 1).alias("missing"))


def missing_slots(slots: DataFrame) -> DataFrame:
    """Slots that are a parent of a stored slot but are not stored themselves."""
    parents = slots.where("parent_slot IS NOT NULL").select(F.col("parent_slot").alias("slot")).distinct()
    return parents.join(slots.select("slot").distinct(), "slot", "left_anti")


def skipped_slots(slots: DataFrame) -> DataFrame:
    """(slot, parent_slot, skipped): numbers between parent and child that the network left out."""
    return slots.where("slot - parent_slot > 1").select("slot", "parent_slot", (F.col("slot") - F.col("parent_slot") - 1).alias("skipped"))


def repair_status(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Each requested slot with its document's status, ``pending`` without a document."""
    return requests.join(status, "slot", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
