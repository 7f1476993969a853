"""Present positions of the event log as a stored set of intervals.

The set is kept in parts of ``PART`` positions; an interval never leaves its part, so a
batch reads and rewrites the parts that it touches and nothing of the history. A part
without holes is one row. Small parts may share a folder: their number then grows with the
positions, that of folders and files does not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.operators.gaps import interval_gaps
from tallyflow.sources import writers

PART = 1_000_000
NAME = "present_positions"
SCHEMA = "low long, high long, part string"


def merged(intervals: DataFrame) -> DataFrame:
    """(part, low, high) with neighbours and overlaps inside a part joined; a part holds at most PART different intervals."""
    order = Window.partitionBy("part").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = intervals.distinct().withColumn("begins", (reach.isNull() | (F.col("low") > reach + 1)).cast("int"))
    run = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begins.withColumn("run", run).groupBy("part", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def add_positions(events: DataFrame, root: str, part: int = PART, together: int = 1) -> int:
    """Add the positions of a batch; adding again changes nothing. Returns the folders rewritten.

    Of ``together`` parts the first names the folder of all; a set keeps to one ``together``.
    """
    spark, path = events.sparkSession, f"{root}/{NAME}"
    own = F.floor(F.col("low") / part)

    def cut(rows: DataFrame) -> DataFrame:
        """Intervals merged in their parts, with the folder's name as ``part``."""
        return merged(rows.select(own.alias("part"), "low", "high")).select("low", "high", (F.floor(F.col("part") / together) * together).cast("string").alias("part"))

    with writers.staging(spark) as staged:
        fresh = staged(cut(events.where("seq IS NOT NULL").select(F.col("seq").alias("low"), F.col("seq").alias("high"))))
        parts = [r.part for r in fresh.select("part").distinct().collect()]
        there = writers.read_folders(spark, path, "part", parts, SCHEMA)
        if there is not None:
            fresh = staged(cut(fresh.unionByName(there)))
        if parts:
            fresh.repartition("part").sortWithinPartitions("part", "low").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(parts)


def intervals(spark: SparkSession, root: str, low: int | None = None, high: int | None = None, part: int = PART, together: int = 1) -> DataFrame | None:
    """Stored intervals, or those of the folders that hold parts between two positions; None if there are none."""
    names = [n for n in writers.folders(spark, f"{root}/{NAME}", "part") if (low is None or int(n) + together > low // part) and (high is None or int(n) <= high // part)]
    return writers.read_folders(spark, f"{root}/{NAME}", "part", names, SCHEMA)


def gap_set(spark: SparkSession, root: str, group: int = 100_000) -> DataFrame:
    """(first_missing, last_missing, missing) of each hole, from the intervals alone."""
    found = intervals(spark, root)
    if found is None:
        return spark.createDataFrame([], "first_missing long, last_missing long, missing long")
    return interval_gaps(found.select("low", "high"), group)


@dataclass(frozen=True)
class Batch:
    """Positions from ``first`` to ``last`` (before it: none), and why they end there: ``full``, ``gap`` or ``end``."""

    first: int
    last: int
    ends: str


def next_batch(spark: SparkSession, root: str, after: int | None, most: int, part: int = PART, together: int = 1) -> Batch:
    """The next positions to replay after a checkpoint (None: from 0): at most ``most``, none beyond the first hole.

    ``gap``: the next position is missing though later ones are there; ``end``: nothing
    later is there. Only the parts of these positions, and the last part, are read.
    """
    first = 0 if after is None else after + 1
    limit = first + most - 1
    last = first - 1
    found = intervals(spark, root, first, limit, part, together)
    if found is not None and most > 0:
        own = found.where((F.col("high") >= first) & (F.col("low") <= limit)).select(F.greatest("low", F.lit(first)).alias("low"), F.least("high", F.lit(limit)).alias("high"))
        low, high = own.agg(F.min("low"), F.max("high")).first()
        if low == first:
            hole = interval_gaps(own).agg(F.min("first_missing")).first()[0]
            last = high if hole is None else hole - 1
    if most <= 0 or last == limit:
        return Batch(first, last, "full")
    parts = [int(n) for n in writers.folders(spark, f"{root}/{NAME}", "part")]
    top = intervals(spark, root, max(parts) * part, None, part, together).agg(F.max("high")).first()[0] if parts else -1
    return Batch(first, last, "gap" if top > last else "end")


def replay(events: DataFrame, batch: Batch) -> DataFrame:
    """The events of a batch of positions, a filter that reaches the scan."""
    return events.where((F.col("seq") >= batch.first) & (F.col("seq") <= batch.last))


def replay_plan(spark: SparkSession, root: str, most: int) -> DataFrame:
    """(first, last, ends) of batches that replay all that is there, in parallel: no batch crosses a hole or a part."""
    found = intervals(spark, root)
    if found is None:
        return spark.createDataFrame([], "first long, last long, ends string")
    follows = found.select((F.col("low") - 1).alias("high"), F.lit(True).alias("goes_on"))
    top = found.agg(F.max("high").alias("top"))
    each = found.join(follows, "high", "left").crossJoin(F.broadcast(top))  # one row on that side
    cut = each.withColumn("first", F.explode(F.sequence("low", "high", F.lit(most).cast("long"))))
    last = F.least(F.col("first") + most - 1, "high")
    ends = F.when((last < F.col("high")) | F.coalesce("goes_on", F.lit(False)), "full").when(F.col("high") == F.col("top"), "end").otherwise("gap")
    return cut.select("first", last.alias("last"), ends.alias("ends"))
