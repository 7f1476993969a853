"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint. ASCII letters are lower-cased, words are runs of non-blank bytes,
shingles are ``width`` consecutive words joined by one space (a shorter text is
one shingle), each hashed with XXH64 (seed 42); a bit is set where more than
half of the hashes have it. A text without words has fingerprint zero.

Join. Two fingerprints that differ in at most 4 bits agree on at least 3 of 7
blocks, so each of the 35 choices of 3 blocks (about 27 bits) is a bucket key:
buckets stay small when the number of fingerprints grows, which single blocks
do not. Equal fingerprints are one row before the join. A bucket is verified
by Hamming distance where its rows meet and sends only a spanning forest of
its links, at most one link fewer than it has members, never all pairs.
Buckets of more than ``CHUNK`` members are dealt as pairs of chunks over many
tasks. Components come from alternating large-star and small-star rounds on
the link table, each round written to the shared folder.

Defined cases: null, empty and blank texts share fingerprint zero and link with
each other and with any fingerprint near zero; a null id never is a component
id unless the whole component has none; repeated rows stay rows of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, documents, row_key, text_bytes, written

WIDTH = 4
MAX_BITS = 4
BLOCKS = 7
SEED = 42
#: Members of a bucket that one task compares; larger buckets are cut in chunks.
CHUNK = 4096


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of one text, repeats included."""
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash64(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    shingles = [line[a:b] for a, b in zip((ends - lengths)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.fromiter(map(hash64, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: a bit is set where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """SimHash of one text; zero without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, rid (a hash of id and text) and fp (the fingerprint as a signed long) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, width) for t in text_bytes(batch["text"])], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["id"], batch["rid"], pa.array(values)], names=["id", "rid", "fp"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    return slim.mapInArrow(by_batch(run), "id long, rid long, fp long")


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks (signed) of all choices of ``blocks - max_bits`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(single, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_links(buckets: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside each run of equal bucket numbers."""
    n, out = len(buckets), []
    low = np.searchsorted(buckets, buckets, "left")
    high = np.searchsorted(buckets, buckets, "right")
    root = np.arange(n)
    step, at = 1, np.flatnonzero(high - np.arange(n) > 1)
    while at.size:
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        for i in near[root[near] != root[near + step]].tolist():
            a, b = int(root[i]), int(root[i + step])
            if a != b:
                own = root[low[i] : high[i]]
                own[own == max(a, b)] = min(a, b)
                out.append((i, i + step))
        step += 1
        at = at[high[at] - at > step]
    return out


def _links_of(max_bits: int):
    def pack(buckets: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(bucket_links(buckets, fps.view(np.uint64), max_bits), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, 0]]), pa.array(fps[pairs[:, 1]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            held_b = np.concatenate([held_b, batch["bucket"].to_numpy()])
            held_f = np.concatenate([held_f, batch["fp"].to_numpy()])
            cut = int(np.searchsorted(held_b, held_b[-1], "left")) if held_b.size else 0  # the last bucket may go on
            if cut:
                yield pack(held_b[:cut], held_f[:cut])
                held_b, held_f = held_b[cut:], held_f[cut:]
        if held_b.size:
            yield pack(held_b, held_f)

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct fingerprints that keep all components."""
    spark = nodes.sparkSession
    keyed = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(max_bits, blocks))])).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > chunk).select("bucket", F.ceil(2 * F.col("n") / chunk).cast("int").alias("chunks")), "large-buckets")
    n_large = large.count()
    if n_large:
        # A row of a large bucket goes to every pair of chunks that has its own.
        side = F.broadcast(large) if n_large <= 100_000 else large
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("bucket", F.least(own, j.cast("long")), F.greatest(own, j.cast("long"))))
        keyed = keyed.join(side, "bucket", "left").select("fp", F.explode(F.when(F.col("chunks").isNull(), F.array("bucket")).otherwise(pairs)).alias("bucket"))
    bounded_batches(spark, 50_000)
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links_of(max_bits), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's least node.

    Large-star and small-star alternate until the edge table no longer changes.
    Only minima are gathered for each node (map-side combined).
    """

    def least_of(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    edges, before = written(edges.select("u", "v"), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = least_of(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "round")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def labelled(df: DataFrame, id_col: str, text_col: str, width: int, max_bits: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and (fp, root) of the distinct fingerprints."""
    bounded_batches(df.sparkSession)
    marked = written(fingerprints(df, id_col, text_col, width), "fingerprints")
    nodes = written(marked.select("fp").distinct(), "nodes")
    found = components(links(nodes, max_bits, blocks)).withColumnRenamed("node", "fp")
    return marked, nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """id, fp (signed long) and component_id of each row."""
    marked, rooted = labelled(df, id_col, text_col, width, max_bits, blocks)
    least = marked.groupBy("fp").agg(F.min("id").alias("least")).join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
