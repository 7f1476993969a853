"""Exact deduplication by content sort, with DataFrame functions only.

Sampled splitters (``repartitionByRange``) deal normalised texts into ranges
of their leading bytes; inside a range Spark's external sort places equal
texts side by side and the window operator compares neighbours in full. Texts are
normalised once and written with their digest and leading bytes, which is all that
counting and sampling read.

Skew. Copies of one text would meet in one range. A first pass counts 64-bit
digests of the normalised text; a digest with more than ``1 / hot_parts`` of
all rows is *hot* (at most ``hot_parts`` digests can be, so the list is
bounded whatever the input). Rows of hot digests carry a salt from their id,
so the splitters cut inside such a group; its parts are then joined by a
second, small comparison of one representative text for each (text, salt).
Texts that share a long prefix but differ later are dealt by the digest,
which is the second sort key.

Defined cases: null text counts as empty; a null id sorts after all others and
is kept only where its group has no other id; of repeated rows with the same
id exactly one is kept; an empty table gives an empty result; other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm._common import documents, written

#: A digest held by more than rows / HOT_PARTS rows is dealt by salt as well.
HOT_PARTS = 1000
#: Salts of a hot text.
SALTS = 256


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_parts: int = HOT_PARTS) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    base = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    base = written(base.withColumns({"digest": F.xxhash64("norm"), "head": F.substring("norm", 1, 32)}), "normalised")

    counts = written(base.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digest-counts")
    rows = base.count()
    hot = [r.digest for r in counts.where(F.col("n") > max(1, rows // hot_parts)).select("digest").collect()]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    salted = base.withColumn("hot", is_hot).withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )

    keys = ["head", "digest", "salt"]
    ranged = salted.repartitionByRange(*keys)
    group = Window.partitionBy(*keys, "norm")
    placed = ranged.select(
        "id", "hot", "digest",
        F.row_number().over(group.orderBy(F.col("id").asc_nulls_last())).alias("place"),
        F.min("id").over(group).alias("least"),
        F.count(F.lit(1)).over(group).alias("size"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("hot"), F.col("norm")).alias("norm"),
    )
    result = [F.col("id").alias(id_col), F.col("least").alias("keep_id"), F.col("size").alias("group_size"),
              ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("least"))).alias("kept"), "text_sha256"]
    if not hot:
        return placed.select(*result)

    # One representative for each (hot text, salt), at most hot_parts * SALTS rows, compared in full once more.
    placed = written(placed.withColumn("norm", F.when(F.col("place") == 1, F.col("norm"))), "placed")
    joined = (
        placed.where("hot and place = 1")
        .groupBy("norm", "text_sha256")
        .agg(F.min("least").alias("all_least"), F.sum("size").alias("all_size"))
        .select("text_sha256", "all_least", "all_size")
    )
    merged = placed.drop("norm").join(F.broadcast(joined), "text_sha256", "left")
    merged = merged.withColumn("size", F.coalesce("all_size", "size")).withColumn("least", F.when(F.col("hot"), F.col("all_least")).otherwise(F.col("least")))
    return merged.select(*result)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
