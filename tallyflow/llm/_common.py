"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space as the contracts define it.
BLANKS = " \t\n\x0b\x0c\r"

_fallback_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent one temporary folder serves sessions whose executors
    are in this process; on a cluster it would be another folder on each machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback_dir:
        _fallback_dir.append("file://" + tempfile.mkdtemp(prefix="tallyflow-"))
    return _fallback_dir[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tallyflow-{uuid.uuid4().hex}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs a re-read of the
    table, never a recomputation of what led to it.
    """
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_key(id_col: Column, text_col: Column) -> Column:
    """A 64-bit key of (id, text); rows that agree in both share it."""
    return F.xxhash64(id_col, text_col)


def wide_row_key(id_col: Column, text_col: Column) -> Column:
    """A 128-bit key of (id, text), for results that two rows with one key would spoil."""
    text = F.coalesce(text_col, F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", id_col.cast("string"), id_col.isNull().cast("string"), text_col.isNull().cast("string"), text).cast("binary")))


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function on one Arrow batch to what ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding to ``str``."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def schema_with(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` followed by the fields of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
