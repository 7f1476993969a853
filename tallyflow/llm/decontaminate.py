"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is
one window). The join asks which windows are contained, in order, in which
documents, so the overlap threshold is the whole window and the necessary
prefix is its first token under a global order by rarity: a document without
a window's rarest word cannot contain it. Rarity is counted over all documents
for the words of the benchmark. Candidates are pairs of a document position
that holds a prefix word and the windows listed under it; the position inside
the window and the length bound the start (positional and length filter), and
the window's words are then compared exactly.

The document side is never shuffled. The index of windows is dealt in blocks
of at most ``block_words`` words, each broadcast by itself, and every block is
joined with all documents; a benchmark beyond one block costs another scan,
not a larger broadcast.

Defined cases: null or wordless texts have no words and no hits; null or
wordless items have no windows; items with a null id count for hits but are
not listed; items that repeat are listed once; empty tables on either side
give documents without hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, documents, schema_with, text_bytes, wide_row_key, written

WINDOW = 10
#: Words in one broadcast block of windows; about 100 bytes each when indexed.
BLOCK_WORDS = 1_000_000

#: Bytes outside words become blanks, A-Z becomes a-z; all bytes of non-ASCII characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words, and the ids of the items that hold them."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, windows = [], []
        for item, text in zip(batch["item"].to_pylist(), text_bytes(batch["text"]), strict=True):
            words = words_of(text)
            for start in range(max(1, len(words) - window + 1) if words else 0):
                items.append(item)
                windows.append(b" ".join(words[start : start + window]))
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], names=["item", "words"])

    slim = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return slim.mapInArrow(by_batch(cut), "item string, words binary").groupBy("words").agg(F.collect_set("item").alias("items"))


def vocabulary_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Occurrences over all documents of each of the given words; summed map-side first."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared.value, Counter()
        for batch in batches:
            for text in text_bytes(batch["text"]):
                total.update(filter(wanted.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_index(windows: list[tuple[bytes, list[str]]], counts: dict[bytes, int]) -> dict[bytes, list[tuple[int, list[bytes], tuple[str, ...]]]]:
    """Under each window's rarest word: its offset in the window, the window's words, the items."""
    index: dict[bytes, list[tuple[int, list[bytes], tuple[str, ...]]]] = {}
    for text, items in windows:
        words = text.split(b" ")
        offset = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        index.setdefault(words[offset], []).append((offset, words, tuple(items)))
    return index


def occurrences(words: list[bytes], index: dict) -> tuple[set[int], set[str]]:
    """Covered word positions, and the items with occurring windows."""
    hit: set[int] = set()
    items: set[str] = set()
    for at in [i for i, w in enumerate(words) if w in index]:
        for offset, window, owners in index[words[at]]:
            start = at - offset
            if start >= 0 and words[start : start + len(window)] == window:
                hit.update(range(start, start + len(window)))
                items.update(owners)
    return hit, items


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with __tf_n_words, __tf_n_hit, __tf_items (sorted as strings) and __tf_items_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*(f.split(" ")[0] for f in _ADDED.split(", ")))  # an earlier result gives way
    windows = written(item_windows(benchmark, item_col, item_text_col, window), "windows")
    blocks = max(1, -(-windows.count() * window // block_words))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))

    def shared_index(block: int):
        own = [(bytes(r["words"]), list(r["items"])) for r in windows.where(F.col("block") == block).collect()]
        vocabulary = sorted({w for text, _ in own for w in text.split(b" ")})
        counts = {bytes(r.word): r.n for r in vocabulary_counts(docs.select(F.col(text_col).alias("text")), vocabulary).collect()} if own else {}
        return spark.sparkContext.broadcast(prefix_index(own, counts))

    if blocks == 1:
        return _joined(docs, text_col, shared_index(0))

    # Several blocks: each finds its hits in all documents, which are written before the next block is
    # broadcast, so one index is held at a time. Hits are merged by row, then applied once.
    rid = wide_row_key(F.col(id_col), F.col(text_col))
    parts = None
    for block in range(blocks):
        shared = shared_index(block)
        found = written(docs.select(rid.alias("__tf_rid"), F.col(text_col).alias("text")).mapInArrow(_hits_of(shared), "__tf_rid binary, at array<int>, items array<string>"), "hits")
        shared.unpersist(blocking=True)
        shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy("__tf_rid").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("__tf_at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__tf_found"))
    joined = docs.withColumn("__tf_rid", rid).join(merged, "__tf_rid", "left").drop("__tf_rid")
    return _finished(joined, text_col)


def _hits_of(shared):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for rid, text in zip(batch["__tf_rid"].to_pylist(), text_bytes(batch["text"]), strict=True):
            hit, items = occurrences(words_of(text), shared.value)
            if hit:
                out.append((rid, sorted(hit), sorted(i for i in items if i is not None)))
        rids, at, items = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["__tf_rid", "at", "items"])

    return by_batch(run)


_ADDED = "__tf_n_words long, __tf_n_hit long, __tf_items array<string>, __tf_items_sha256 string"


def _with_result(batch: pa.RecordBatch, names: list[str], n_words: list[int], n_hit: list[int], items: list[list[str]]) -> pa.RecordBatch:
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    arrays = [batch[n] for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.split(" ")[0] for f in _ADDED.split(", "))])


def _joined(docs: DataFrame, text_col: str, shared) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, found = [], [], []
        for text in text_bytes(batch[text_col]):
            words = words_of(text)
            hit, items = occurrences(words, shared.value)
            n_words.append(len(words))
            n_hit.append(len(hit))
            found.append(sorted(i for i in items if i is not None))
        return _with_result(batch, batch.schema.names, n_words, n_hit, found)

    return docs.mapInArrow(by_batch(run), schema_with(docs, _ADDED))


def _finished(joined: DataFrame, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words = [len(words_of(text)) for text in text_bytes(batch[text_col])]
        n_hit = [len(x or ()) for x in batch["__tf_at"].to_pylist()]
        found = [sorted(x or ()) for x in batch["__tf_found"].to_pylist()]
        return _with_result(batch, [n for n in batch.schema.names if n not in ("__tf_at", "__tf_found")], n_words, n_hit, found)

    return joined.mapInArrow(by_batch(run), schema_with(joined.drop("__tf_at", "__tf_found"), _ADDED))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", F.col("__tf_n_words").alias("n_words"), F.col("__tf_n_hit").alias("n_hit"), F.size("__tf_items").cast("long").alias("n_items"),
        F.col("__tf_items_sha256").alias("items_sha256"), (F.col("__tf_n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM pos, lens WHERE i + n - 1 <= len(w)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
