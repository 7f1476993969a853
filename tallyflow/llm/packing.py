"""Sequence packing along a space-filling curve.

A document's byte trigrams are hashed into a vector, projected by a fixed
random matrix to ``DIMS`` dimensions and numbered along a Hilbert curve.
Documents are written once with their keys; bytes are summed for each cell of the
curve (at most 2 ** ``MOST_CELL_BITS`` cells), and ranges of cells with about equal
bytes become partitions, so that long documents that lie near each other do not
make one range large. A cell of more than a range's bytes (many copies of a text)
is dealt by row to several partitions. Inside a partition documents are sorted by
(Hilbert key, id, row), so neighbours on the curve share a sequence. There tokens
are laid end to end and cut every ``LENGTH``; what remains at the end of a
partition is cut into sequences whose lengths are powers of two, which need no
padding. Texts are tokenized once, after the shuffle.

The ids are those of the byte-level BPE vocabulary; the encoder reads the
rank form of the same vocabulary, which gives the same ids several times
faster (a test compares the two).

Defined cases: null text counts as empty and is the single end id; null ids sort
first; repeated rows are packed one by one; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, documents, schema_with, text_bytes, written

LENGTH = 2048
END_ID = 1
DIMS = 4
BITS = 10
BUCKETS = 1024
#: Bytes of a range from which on there are more ranges than shuffle partitions.
RANGE_BYTES = 128 << 20
MOST_CELL_BITS = 20
VOCABULARY = "byte_bpe_50k.tiktoken"

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of one text followed by the end id, little-endian unsigned 32-bit."""
    ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def coordinates(text: bytes | None) -> np.ndarray:
    """A text's place in the unit cube."""
    raw = np.frombuffer((text or b"") + b"   ", np.uint8).astype(np.uint32)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
    vector = np.sqrt(np.bincount(mixed, minlength=BUCKETS))
    return 0.5 + 0.5 * np.tanh(vector @ projection() / np.linalg.norm(vector))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates below ``2 ** bits``."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & p, 0)
            x[0] = np.where(swap, x[0] ^ t, x[0] ^ p)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def with_curve_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with __tf_curve, the place of the text along the curve."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = np.array([coordinates(t) for t in text_bytes(batch[text_col])]).reshape(-1, DIMS)
        keys = hilbert_keys(np.minimum(places * (1 << BITS), (1 << BITS) - 1))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "__tf_curve"])

    return df.mapInArrow(by_batch(run), schema_with(df, "__tf_curve long"))


def ranges_of(cells: list[tuple[int, int]], parts: int) -> tuple[list[tuple[int, int, int]], int]:
    """For each (cell, bytes), in order, its first partition and over how many it is dealt; and the partitions in all.

    About ``parts`` partitions of equal bytes.
    """
    most = max(1, -(-sum(n for _, n in cells) // parts))
    out, part, filled = [], 0, 0
    for cell, n in cells:
        if filled and filled + n > most:
            part, filled = part + 1, 0
        over = -(-n // most)
        out.append((cell, part, over))
        if over > 1:
            part, filled = part + over, 0
        else:
            filled += n
    return out, part + bool(filled)


def along_curve(df: DataFrame) -> DataFrame:
    """``df`` (id, text) in partitions of about equal bytes along the curve, each in order."""
    spark = df.sparkSession
    keyed = with_curve_key(df).withColumns({"__tf_row": F.monotonically_increasing_id(), "__tf_bytes": F.octet_length(F.coalesce("text", F.lit(""))) + 64})
    keyed = written(keyed, "curve")
    total = keyed.agg(F.sum("__tf_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    bits = min(MOST_CELL_BITS, parts.bit_length() + 5)
    cell = F.shiftright("__tf_curve", DIMS * BITS - bits).alias("__tf_cell")
    sizes = sorted((r["__tf_cell"], r.n) for r in keyed.groupBy(cell).agg(F.sum("__tf_bytes").alias("n")).collect())
    ranges, n_parts = ranges_of(sizes, parts)
    places = spark.createDataFrame(ranges, "__tf_cell long, __tf_part int, __tf_over int")  # at most 2 ** bits rows
    placed = keyed.withColumn("__tf_cell", cell).join(F.broadcast(places), "__tf_cell")
    part = (F.col("__tf_part") + F.pmod(F.xxhash64("__tf_row"), F.col("__tf_over")).cast("int")).alias("__tf_part")
    return placed.select("id", "text", "__tf_curve", "__tf_row", part).repartitionById(max(1, n_parts), "__tf_part").sortWithinPartitions("__tf_curve", "id", "__tf_row").select("id", "text")


def powers_of_two(total: int) -> list[int]:
    """The powers of two that add up to ``total``, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class Packer:
    """Lays documents end to end; ``pieces`` holds finished rows."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.length, self.sequence, self.filled = length, first_sequence, 0
        self.pieces: list[tuple] = []
        self.open: list[tuple] = []  # pieces of the sequence not yet full, with their ids

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.length - self.filled]
            self.open.append((doc, start, len(ids), part))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.length:
                self._close([self.length])

    def finish(self) -> None:
        self._close(powers_of_two(self.filled))

    def _close(self, lengths: list[int]) -> None:
        parts = iter(self.open)
        current = None
        for length in lengths:
            offset = 0
            while offset < length:
                doc, start, total, ids = current or next(parts)
                part = ids[: length - offset]
                self.pieces.append((doc, start, len(part), zlib.crc32(part.tobytes()), total, self.sequence, offset))
                offset += len(part)
                current = (doc, start + len(part), total, ids[len(part) :]) if len(part) < len(ids) else None
            self.sequence += 1
        self.open, self.filled = [], 0


def _pack_partition(length: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, length)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.pieces, strict=True)) or [()] * 7
            packer.pieces = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split(" ")[0] for f in PIECES.split(", ")])

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                packer.add(doc, token_ids(text, vocabulary))
            yield rows()
        packer.finish()
        yield rows()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of a document: where it starts, and its place in a sequence."""
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return along_curve(slim).mapInArrow(_pack_partition(length, vocabulary), PIECES).withColumnRenamed("id", id_col)


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
