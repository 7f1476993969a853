"""The layout job: closed buckets of many small files become few sorted ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.schemas import TABLES
from tallyflow.sources import key_index, writers

#: What a bucket waits for after its end, and the bytes that a file should have.
SETTLE, FILE_BYTES = "15 minutes", 128 << 20


def layout_plan(spark: SparkSession, root: str, table: str, as_of, settle: str = SETTLE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(bucket, files, bytes, wanted) of the closed buckets with more files than their bytes need.

    From the names and sizes of files alone: executors list the folders, no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/{table}")
    unit = TABLES[table].bucket
    length = unit if " " in unit else f"1 {unit}"
    found = files.groupBy(F.col("bucket").cast("string").alias("bucket")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    begins = F.col("bucket").cast("timestamp_ntz")
    ends = F.when(F.length("bucket") == writers.MONTH, F.add_months(begins.cast("date"), 1).cast("timestamp_ntz")).otherwise(begins + F.expr(f"INTERVAL {length}"))
    closed = ends + F.expr(f"INTERVAL {settle}") <= F.lit(as_of).cast("timestamp_ntz")
    wanted = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(file_bytes))).cast("long")
    return found.where(closed).select("bucket", "files", "bytes", wanted.alias("wanted")).where("files > wanted")


def run_layout(spark: SparkSession, root: str, as_of, tables: Sequence[str] = tuple(TABLES), settle: str = SETTLE, file_bytes: int = FILE_BYTES) -> dict[str, int]:
    """Compact what the plan picks, and the indexes of stored keys; the buckets rewritten of each table.

    A bucket is rewritten as a whole or not at all, so a failed run leaves the rest for the next.
    """
    done = {}
    for table in tables:
        if table == "ingestion_checkpoints" or not writers.exists(spark, f"{root}/{table}"):
            continue
        picked = [r.bucket for r in layout_plan(spark, root, table, as_of, settle, file_bytes).collect()]
        if picked:
            writers.compact(spark, root, table, picked)
        done[table] = len(picked)
    kept = {name for table in ("transactions", "transaction_program_ids", "account_updates") for name in writers.folders(spark, f"{root}/{table}")}
    for index in (key_index.by_signature(root), key_index.by_slot(root)):
        index.compact(spark, sorted(kept))
    return done
