"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record is hashed to one of ``VIRTUAL_SLOTS`` slots; the bytes and rows of
each slot are aggregated (a table of at most ``VIRTUAL_SLOTS`` rows whatever
the input). Version 0 of the map deals slots round robin. Rebalancing writes a
new version that differs by as few moves as it can: slots leave shards above
the mean for shards below it until no move or swap improves the balance. Maps are stored
as Parquet, all versions in one table, so that a reader can go back.

The law of ``op2_virtual_slots`` is ``bytes``: shard sizes are near equal. A
record alone larger than a fair share makes the bound its own size.

Defined cases: null text has no bytes (size is the fixed overhead alone) and the
CRC of the empty string; null ids hash with their text; repeated rows are
records of their own; an empty table gives an empty result and an even map.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm._common import documents, new_path, written

VIRTUAL_SLOTS = 8192
SHARDS = 40
OVERHEAD = 16


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """id, size, text_crc32 and vslot of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot in use: at most as many rows as slots."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalanced(slot_to_shard: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """A new version of the map with near-equal bytes.

    Works on the slot table alone (its length is fixed). Each step takes the
    heaviest and the lightest shard and moves the slot, or swaps the pair of
    slots, that brings the two nearest to each other.
    """
    out = list(slot_to_shard)
    used = [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            used[shard] += sizes.get(slot, 0)
    for slot in sorted((k for k, shard in enumerate(out) if shard >= shards), key=lambda k: (-sizes.get(k, 0), k)):
        lightest = min(range(shards), key=used.__getitem__)  # shards that are no more give their slots away
        out[slot] = lightest
        used[lightest] += sizes.get(slot, 0)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        insort(held[shard], (sizes.get(slot, 0), slot))
    load = [sum(s for s, _ in own) for own in held]

    def nearest(own: list[tuple[int, int]], want: float) -> tuple[int, int] | None:
        at = bisect_left(own, (want, -1))
        near = own[max(0, at - 1) : at + 1]
        return min(near, key=lambda x: abs(x[0] - want), default=None)

    for _ in range(50 * len(out)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best = (gap, None, None)  # what is left of the gap, the slot that leaves, the slot that comes back
        for back in [None, *held[low][:: max(1, len(held[low]) // 64)]]:
            away = nearest(held[high], gap / 2 + (back[0] if back else 0))
            if away:
                left = abs(gap - 2 * (away[0] - (back[0] if back else 0)))
                if left < best[0]:
                    best = (left, away, back)
        _, away, back = best
        if away is None:
            break
        for item, source, to in ((away, high, low), (back, low, high)):
            if item:
                held[source].remove(item)
                insort(held[to], item)
                load[source] -= item[0]
                load[to] += item[0]
                out[item[1]] = to
    return out


def append_version(spark: SparkSession, path: str, version: int, slot_to_shard: list[int]) -> None:
    """Write one version of the map; fails if it is there."""
    rows = list(enumerate(slot_to_shard))
    spark.createDataFrame(rows, "vslot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def read_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """One stored version: the shard of each slot."""
    rows = spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}").collect()
    return [r.shard for r in sorted(rows, key=lambda r: r.vslot)]


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every record: id, size, text_crc32, vslot, map_version, shard, slot.

    ``slot`` numbers the records of a shard from 0 without gaps. The numbers
    come from a window over each virtual slot plus the rows of the shard's
    earlier virtual slots, so no task ever holds a whole shard.
    """
    spark = df.sparkSession
    records = written(slotted(df, id_col, text_col, slots), "records")
    table = {r.vslot: (r.bytes, r.rows) for r in slot_bytes(records).collect()}
    path = map_path or new_path(spark, "slot-map")
    versions = stored_versions(spark, path)
    if versions:
        version, current = versions[-1], read_map(spark, path, versions[-1])
        if len(current) != slots:
            raise ValueError(f"the stored map has {len(current)} slots, not {slots}")
    else:
        version, current = 0, first_map(slots, shards)
        append_version(spark, path, 0, current)
    newest = rebalanced(current, {k: v[0] for k, v in table.items()}, shards)
    if newest != current or not versions:
        version += 1
        append_version(spark, path, version, newest)
    stored = spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}").withColumn("version", F.lit(version))

    before, rows = [0] * shards, []
    for vslot, number in enumerate(newest):
        rows.append((vslot, before[number]))
        before[number] += table.get(vslot, (0, 0))[1]
    base = spark.createDataFrame(rows, "vslot int, base long")
    placing = stored.join(F.broadcast(base), "vslot").select("vslot", "shard", "base", F.col("version").alias("map_version"))

    order = Window.partitionBy("vslot").orderBy(F.col("id").asc_nulls_last(), "text_crc32", "size")
    numbered = records.withColumn("place", F.row_number().over(order))
    return numbered.join(F.broadcast(placing), "vslot").select(
        F.col("id").alias(id_col), "size", "text_crc32", "vslot", "map_version", "shard",
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )
