"""Where a stored row is, by something that its time bucket does not tell.

An index holds (part, key, bucket) entries beside a table: the key is a number or the
hash of a value, the part a prefix of it. Entries are added before the rows, and rows
are compared themselves, so an entry without a row, a double entry or two values with
one hash only cost a look at a bucket; none can hide a row or make one up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a hashed index, and slots that share a part.
HASHED_PARTS, SLOTS = 32, 100_000


def hashed(*columns: str) -> tuple[Column, Column]:
    """Part and key of a value of any type."""
    key = F.xxhash64(*columns)
    return F.pmod(key, F.lit(HASHED_PARTS)).cast("int"), key


def ranged(column: str, width: int = SLOTS) -> tuple[Column, Column]:
    """Part and key of a number; neighbours share a part."""
    key = F.col(column).cast("long")
    return F.floor(key / F.lit(width)).cast("long"), key


@dataclass(frozen=True)
class KeyIndex:
    """Entries of one kind of key, stored under ``path`` by part."""

    path: str
    of: Callable[[], tuple[Column, Column]]

    def entries(self, rows: DataFrame) -> DataFrame:
        part, key = self.of()
        # distinct needs no shuffle of its own, as equal entries share a part
        return rows.select(part.alias("part"), key.alias("key"), "bucket").repartition("part").distinct()

    def add(self, rows: DataFrame) -> None:
        """Add entries of rows that have a bucket. One file for each part."""
        self.entries(rows).write.mode("append").partitionBy("part").parquet(self.path)

    def stored(self, spark: SparkSession, parts: list | None = None) -> DataFrame | None:
        """All entries, or those of some parts; None if there are none."""
        from tallyflow.sources.writers import read_folders

        return read_folders(spark, self.path, "part", None if parts is None else [str(p) for p in parts], "key long, bucket string, part long")

    def buckets_of(self, rows: DataFrame) -> list[str]:
        """Names of the buckets that may hold rows with a key in ``rows``; only the parts of these keys are read."""
        part, key = self.of()
        asked = rows.select(part.cast("long").alias("part"), key.alias("key"))
        parts = sorted(r.part for r in asked.select("part").distinct().collect() if r.part is not None)
        found = self.stored(rows.sparkSession, parts)
        if found is None:
            return []
        return sorted(r.bucket for r in found.join(asked, ["part", "key"], "left_semi").select("bucket").distinct().collect())

    def compact(self, spark: SparkSession, keep: list[str]) -> None:
        """Rewrite the entries of the buckets in ``keep``, each once; those of other buckets go."""
        from tallyflow.sources.writers import drop_folder, folders, staging

        found = self.stored(spark)
        if found is None:
            return
        with staging(spark) as staged:
            rest = staged(found.where(F.col("bucket").isin(keep)).distinct())
            left = {str(r.part) for r in rest.select("part").distinct().collect()}
            if left:
                rest.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
            for part in folders(spark, self.path, "part").keys() - left:
                drop_folder(spark, self.path, "part", part)


def by_signature(root: str) -> KeyIndex:
    """Buckets of transactions, and of their programs, by signature."""
    return KeyIndex(f"{root}/transactions_by_signature", lambda: hashed("signature"))


def by_slot(root: str) -> KeyIndex:
    """Buckets of transactions and account updates by slot."""
    return KeyIndex(f"{root}/rows_by_slot", lambda: ranged("slot"))
