"""Block times that come after the rows they belong to.

Block times are kept in a table of their own. A row is timed by what is known when it
is stored, else by arrival; when its block time is learned later, the stored row moves to
that time, with the rows that hang on it. So the tables hold the same rows whatever the
order of arrival. ``held_for_block_time`` makes moves rare: on a stream it holds a row
until its block time or a time-out has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources import key_index, writers

TIMED = ("account_updates", "transactions")


def _part(column: str = "slot"):
    return key_index.ranged(column)[0].alias("part")


def learned(events: DataFrame) -> DataFrame:
    """(seq, slot, block_time) of the block-time events, the last of each slot; without a time, arrival stands in."""
    own = events.where("kind = 'block_meta'").select("seq", "slot", F.coalesce("block_meta.block_time", "observed_at").alias("block_time"))
    return own.groupBy("slot").agg(F.max("seq").alias("seq"), F.max_by("block_time", "seq").alias("block_time")).select("seq", "slot", "block_time")


def remember(times: DataFrame, root: str) -> None:
    """Add to the stored block times. Of several for a slot the last by seq holds, so adding twice changes nothing."""
    times.withColumn("part", _part()).repartition("part").write.mode("append").partitionBy("part").parquet(f"{root}/block_times")


def known_times(slots: DataFrame, root: str, given: DataFrame | None = None) -> DataFrame:
    """(slot, block_time) of ``slots``: what is stored, else what is given. Only the parts of these slots are read."""
    spark = slots.sparkSession
    wanted = slots.select("slot").where("slot IS NOT NULL").distinct()
    parts = [str(r.part) for r in wanted.select(_part()).distinct().collect()]
    found = writers.read_folders(spark, f"{root}/block_times", "part", parts)
    sources = [] if found is None else [found.select("slot", "seq", "block_time")]
    if given is not None:
        sources.append(given.select("slot", F.lit(None).cast("long").alias("seq"), "block_time"))
    if not sources:
        return wanted.select("slot", F.lit(None).cast("timestamp").alias("block_time")).limit(0)
    every = sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])
    last = F.max_by("block_time", F.coalesce("seq", F.lit(-(2**62)))).alias("block_time")
    return every.join(wanted, "slot", "left_semi").groupBy("slot").agg(last)


def correct_times(times: DataFrame, root: str) -> dict[str, int]:
    """Move stored rows of the slots in ``times`` (slot, block_time) to their block time; the rows moved of each table.

    Only buckets that hold rows of these slots are read. Safe to repeat: the rows that hang
    on a transaction move before it does.
    """
    spark = times.sparkSession
    slot_index, signatures = key_index.by_slot(root), key_index.by_signature(root)
    names = slot_index.buckets_of(times)
    moved = dict.fromkeys(TIMED, 0)
    if not names:
        return moved
    with writers.staging(spark) as staged:
        for table in TIMED:
            stored = writers.read_folders(spark, f"{root}/{table}", names=names)
            if stored is None:
                continue
            kind = stored.schema["timestamp"].dataType
            to = times.select("slot", F.col("block_time").cast(kind).alias("to_time"))
            # three columns tell which folders hold rows that move; whole rows are read of these only
            late = staged(stored.select("bucket", "slot", "timestamp").join(to, "slot").where("timestamp <> to_time").select("bucket", "slot", "to_time").distinct())
            own = writers.read_folders(spark, f"{root}/{table}", names=[r.bucket for r in late.select("bucket").distinct().collect()], schema=stored.schema)
            if own is None:
                continue
            to_time = F.when(F.col("timestamp") != F.col("to_time"), F.col("to_time")).alias("to_time")
            rows = staged(writers.with_target(own.join(late.select("slot", "to_time").distinct(), "slot", "left").select(*stored.columns, to_time), table))
            wrong = rows.where("to_time IS NOT NULL")
            moved[table] = wrong.count()
            if table == "transactions":
                _move_programs(spark, wrong, root, staged)
            writers.move_rows(rows, root, table, [slot_index, *([signatures] if table == "transactions" else [])])
    return moved


def _move_programs(spark: SparkSession, transactions: DataFrame, root: str, staged) -> None:
    names = [r.bucket for r in transactions.select("bucket").distinct().collect()]
    programs = writers.read_folders(spark, f"{root}/transaction_program_ids", names=names)
    if programs is None:
        return
    # programs have the bucket of their transaction
    own = staged(programs.join(transactions.select("timestamp", "signature", "to_time", "to_bucket"), ["timestamp", "signature"], "left").select(*programs.columns, "to_time", "to_bucket"))
    if not own.where("to_time IS NOT NULL").isEmpty():
        writers.move_rows(own, root, "transaction_program_ids")


def held_for_block_time(events: DataFrame, metas: DataFrame, wait: str = "1 minute", time: str = "observed_at") -> DataFrame:
    """A stream of ``events`` with ``timestamp``: their slot's block time, else arrival once the time-out has passed.

    ``metas`` streams (slot, observed_at, block_time). Both sides are kept for ``wait`` of
    event time only; a block time that comes later is for ``correct_times``.
    """
    left = events.withWatermark(time, wait)
    right = metas.select(F.col("slot").alias("__slot"), F.col(time).alias("__at"), "block_time").withWatermark("__at", wait)
    near = (F.col("slot") == F.col("__slot")) & (F.col("__at") >= F.col(time) - F.expr(f"INTERVAL {wait}")) & (F.col("__at") <= F.col(time) + F.expr(f"INTERVAL {wait}"))
    return left.join(right, near, "left_outer").withColumn("timestamp", F.coalesce("block_time", time)).drop("__slot", "__at", "block_time")
