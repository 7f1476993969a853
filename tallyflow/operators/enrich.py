"""Lookups by slot and by sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_block_time(events: DataFrame, block_times: DataFrame) -> DataFrame:
    """``events`` with ``timestamp``: the slot's block time, else arrival.

    No broadcast hint: the dimension grows with the chain. Spark broadcasts it
    while its measured size allows, and merges otherwise.
    """
    return events.join(block_times.select("slot", "block_time"), "slot", "left").withColumn("timestamp", F.coalesce("block_time", "observed_at")).drop("block_time")


def newest_slots(block_times: DataFrame, keep: int = 1000) -> DataFrame:
    """The block times of the newest slots."""
    return block_times.orderBy(F.desc("slot")).limit(keep)


def with_slot(seqs: DataFrame, seq_slot: DataFrame) -> DataFrame:
    """Slot of each sequence number; null where none was written."""
    return seqs.join(seq_slot.select("seq", "slot"), "seq", "left")
