"""Repair of missing slots until nothing is left to ask for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import gaps, project
from tallyflow.sources import writers
from tallyflow.streaming.ingest import apply_backfill

NAME = "repair_status"
#: What is not asked for again: the slot is stored, or the network has left it out.
SETTLED = ("repaired", "unavailable")
#: Rounds whose blocks are stored by one write.
TOGETHER = 8


def statuses(spark: SparkSession, root: str) -> DataFrame | None:
    """(slot, status, round) of every request so far, the last one of each slot; None before the first."""
    found = writers.read_folders(spark, f"{root}/{NAME}", "round", None, "slot long, status string, round long")
    return None if found is None else found.groupBy("slot").agg(F.max_by("status", "round").alias("status"), F.max("round").alias("round"))


def repair(spark: SparkSession, root: str, fetch: Callable[[DataFrame], DataFrame], as_of) -> int:
    """Store the blocks of missing parents, then of their missing parents, until no slot is missing that was not asked for.

    ``fetch`` takes slots to ask for and gives the block documents there are. The first
    round looks at all stored slots; each later one at the parents of what the last has
    brought. Blocks of up to ``TOGETHER`` rounds are stored by one write, as rounds mostly
    bring neighbours and so touch the same buckets. Statuses are stored after these rows, so a
    run that fails asks for its unstored rounds again. ``pending`` and ``failed`` slots are
    asked for once in a run. Returns the rounds.
    """
    number = first = 1 + max((int(n) for n in writers.folders(spark, f"{root}/{NAME}", "round")), default=-1)
    now = F.lit(as_of).cast("timestamp")
    while True:
        slots = writers.read_folders(spark, f"{root}/slots")
        if slots is None:
            return number - first
        with writers.staging(spark) as staged:
            # two columns of many small files, which each round is compared with
            stored = staged(slots.select("slot", "parent_slot"))
            known = statuses(spark, root)
            asked = stored.select("slot").limit(0) if known is None else known.where(F.col("status").isin(*SETTLED) | (F.col("round") >= first)).select("slot")
            if number == first:
                missing = gaps.missing_slots(stored)
            else:
                last = writers.read_folders(spark, f"{root}/{NAME}", "round", [str(number - 1)], "slot long, status string, round long").where("status = 'repaired'")
                missing = _missing_parents(stored.join(last.select("slot"), "slot", "left_semi"), stored)
            rounds: list[tuple[DataFrame, DataFrame]] = []
            while len(rounds) < TOGETHER:
                requests = staged(missing.join(asked, "slot", "left_anti"))
                if requests.isEmpty():
                    break
                documents = staged(fetch(requests).join(requests, "slot", "left_semi"))
                rounds.append((requests, documents))
                asked = asked.unionByName(requests)
                missing = _missing_parents(project.backfill_slots(documents, now), stored)
            if rounds:
                apply_backfill(reduce(DataFrame.unionByName, [documents for _, documents in rounds]), root, as_of)
                each = [gaps.repair_status(requests, project.block_status(documents)).withColumn("round", F.lit(number + k)) for k, (requests, documents) in enumerate(rounds)]
                reduce(DataFrame.unionByName, each).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(f"{root}/{NAME}")
        number += len(rounds)
        if len(rounds) < TOGETHER:
            return number - first


def _missing_parents(brought: DataFrame, stored: DataFrame) -> DataFrame:
    """Parents of slots just brought that are not among the stored slots."""
    parents = brought.where("parent_slot IS NOT NULL").select(F.col("parent_slot").alias("slot")).distinct()
    return parents.join(stored.select("slot"), "slot", "left_anti")
