"""Current state of accounts beside their history: the newest version of a key wins.

Versions are appended to a table that is bucketed and sorted by key, so reading the state
groups inside buckets and needs no shuffle. A batch adds its own newest versions; one
that comes again or late changes nothing, as the greatest (write_version, timestamp)
holds. Compaction writes a new version of the table with one row for each key; readers
take the newest version that is complete.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources import writers

BUCKETS = 64


def _folder(root: str, version: int) -> str:
    return f"{root}/accounts_current/v={version}"


def _name(root: str, version: int) -> str:
    return f"tallyflow_{hashlib.sha256(root.encode()).hexdigest()[:16]}_{version}"


def _version(spark: SparkSession, root: str) -> int:
    """The newest complete version; 0 if there is none."""
    files, where = writers._path(spark, f"{root}/accounts_current/v=*/_SUCCESS")
    return max((int(f.getPath().getParent().getName().partition("=")[2]) for f in files.globStatus(where) or []), default=0)


def _save(rows: DataFrame, root: str, version: int, mode: str, buckets: int) -> None:
    laid = rows.repartition(buckets, "pubkey").sortWithinPartitions("pubkey")
    laid.write.mode(mode).format("parquet").bucketBy(buckets, "pubkey").sortBy("pubkey").option("path", _folder(root, version)).saveAsTable(_name(root, version))


def _table(spark: SparkSession, root: str, version: int, buckets: int) -> DataFrame:
    """The stored version; a session that has not written it registers it by its folder."""
    name = _name(root, version)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(_folder(root, version)).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (pubkey) SORTED BY (pubkey) INTO {buckets} BUCKETS LOCATION '{_folder(root, version)}'")
    return spark.table(name)


def newest(rows: DataFrame) -> DataFrame:
    """One row for each key: the greatest (write_version, timestamp)."""
    rest = [c for c in rows.columns if c != "pubkey"]
    return rows.groupBy("pubkey").agg(F.max_by(F.struct(*rest), F.struct("write_version", "timestamp")).alias("a")).select("pubkey", *[f"a.{c}" for c in rest])


def add_versions(accounts: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Add a batch of account rows (pubkey, timestamp, slot, owner, lamports, data, write_version)."""
    spark = accounts.sparkSession
    version = max(1, _version(spark, root))
    if _version(spark, root):
        _table(spark, root, version, buckets)
    _save(newest(accounts), root, version, "append", buckets)


def current_accounts(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    """The current row of each key, without a shuffle."""
    return newest(_table(spark, root, _version(spark, root), buckets))


def compact_current(spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
    """A new version of the table with one row for each key; earlier versions go once it is complete."""
    version = _version(spark, root)
    _save(current_accounts(spark, root, buckets), root, version + 1, "overwrite", buckets)
    spark.sql(f"DROP TABLE IF EXISTS {_name(root, version)}")
    writers.drop_folder(spark, f"{root}/accounts_current", "v", str(version))
