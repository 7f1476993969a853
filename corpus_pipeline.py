"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage works on all that its predecessor kept and, but for the last, returns
the columns of ``documents``. Stages keep clean documents:

* language ID drops texts that are null, have no letter, or are in none of the
  learned languages (evidence below the model's bound, which training texts set);
  ``lang`` becomes the predicted one where it is missing, or where the mean word
  marginal is at least ``SURE``;
* line dedup drops repeated lines from texts (and sets ``n_chars``), never rows;
* near-dedup keeps the row with the least id of each component of texts whose
  five-word sets have a Jaccard similarity of 0.8 or more;
* decontamination drops documents that hold a window of a benchmark item;
* packing returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import decontaminate, langid, line_dedup, near_dedup as near_copies, packing
from tallyflow.llm._common import written

#: Mean word marginal from which a prediction holds over the label that came with the document.
SURE = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    tagged = langid.predict(docs, model)
    known = tagged.where((F.col("__tf_lang") != langid.UNKNOWN) & (F.col("__tf_evidence") >= model.least_evidence))
    return known.withColumn("lang", F.when(F.col("__tf_score") >= SURE, F.col("__tf_lang")).otherwise(F.coalesce("lang", "__tf_lang"))).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs)
    changed = F.col("__tf_n_dropped") > 0
    return out.withColumn("text", F.col("__tf_kept")).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.near_dedup(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("__tf_n_hit = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, hashes and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
