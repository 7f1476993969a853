"""Sources: event stream, block documents, stored tables, watchlists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import time_bucket
from tallyflow.schemas import BLOCK, BRONZE, TABLES, WATCHLIST


def read_events(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None, schema=BRONZE, form: str = "parquet") -> DataFrame:
    """The event stream, as a batch or as a stream of the files in a landing folder."""
    if not streaming:
        return spark.read.schema(schema).format(form).load(path)
    reader = spark.readStream.schema(schema).format(form)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def after_seq(df: DataFrame, last: int | None) -> DataFrame:
    """Replay from a position: what follows ``last``, or all if there is none."""
    return df if last is None else df.where(F.col("seq") > last)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block documents (JSON); a document that cannot be read is a row in ``_corrupt_record``."""
    return spark.read.schema(f"{BLOCK}, _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)


def read_table(spark: SparkSession, root: str, name: str, since=None, until=None) -> DataFrame:
    """A stored table between two times; only buckets that can hold such rows are read."""
    df, unit = spark.read.parquet(f"{root}/{name}"), TABLES[name].bucket
    for bound, op in ((since, "ge"), (until, "lt")):
        if bound is not None:
            value = F.lit(bound).cast(df.schema["timestamp"].dataType)
            edge = time_bucket(value, unit).cast("timestamp_ntz").cast("string")
            if op == "ge":
                # a month's folder may hold later buckets of that month
                df = df.where(((F.col("bucket") >= edge) | F.startswith(edge, F.col("bucket").cast("string"))) & (F.col("timestamp") >= value))
            else:
                df = df.where((F.col("bucket") <= edge) & (F.col("timestamp") < value))
    return df


def watchlist(rows: DataFrame) -> DataFrame:
    """A watchlist with defaults: slots are not wanted, block times are."""
    have = {f.name for f in rows.schema}
    defaults = {"include_slots": False, "include_blocks_meta": True}
    return rows.select(
        *(F.col(n) for n in ("protocol", "kind", "key")),
        *(F.coalesce(F.col(n), F.lit(d)).alias(n) if n in have else F.lit(d).alias(n) for n, d in defaults.items()),
    )


def watchlist_of(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return watchlist(spark.createDataFrame(list(rows), WATCHLIST))
