"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes; tokens whose byte ranges overlap are linked. For
each pair of linked ids (a, b) an index holds the documents with the pair:

* A text is cut before blanks that follow a visible character. Neither tokenizer has
  a token over such a place, so each segment is encoded alone, once for a worker's
  cache, and a document is the sum of its segments.
* Documents are numbered by (block, low 16 bits). A task collects postings (pair,
  document, multiplicity) and writes them in runs: for each pair and block a
  compressed bitmap of its documents, sorted numbers or bits whichever is shorter, and
  one more bitmap for each binary digit of (multiplicity - 1), the planes.
* Runs of a block are OR-merged over tasks by (pair, block), so no task ever holds all
  bitmaps of a frequent pair. Populations give the pair's documents and links (plane k
  weighs 2 ** k), which are summed for each pair, combined before the shuffle.
* Counts join the bitmaps, these go to their blocks as postings, and each block adds
  them up for its documents.

Defined cases: a text that is null, empty, or that either tokenizer does not give back
byte for byte (behind one blank) has no tokens: zeros and an empty ``groups_sha256``;
names of special tokens are plain text; null ids pass through; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from tallyflow.llm._common import bounded_batches, documents, written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BLOCK_DOCS = 1 << 16
#: Postings from which on a task writes a run.
RUN_POSTINGS = 2_000_000
#: Bytes, about, of the segments that a worker remembers, and characters from which on one is not remembered.
CACHED_BYTES, LONGEST_CACHED = 100 << 20, 64
#: New segments that are encoded in one text, segments whose groups are hashed at once, and documents of bitmaps that are added at once.
JOINED, HASHED, ADDED = 1000, 100_000, 1_000_000
ID_BITS = 20

POSTING, DOCUMENT = 0, 1
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
INDEX = "kind byte, block long, a int, b int, docs binary, planes array<binary>, low int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _place(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


class Vocabulary:
    """The ids of texts; of each id its bytes, their number, and its digits with what may follow them."""

    def _set(self, bytes_of: list[bytes]) -> None:
        self.bytes_of, self.lengths = bytes_of, np.array([len(x) for x in bytes_of], np.int64)
        self.text = {mark: np.array([f"{i}{mark}" for i in range(len(bytes_of))], object) for mark in ",|;\n"}


class ByteLevel(Vocabulary):
    """A byte-level vocabulary."""

    def __init__(self, vocabulary: str):
        self._tokenizer = Tokenizer.from_file(_place(vocabulary))
        self._tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        size = self._tokenizer.get_vocab_size()
        self._set([bytes(byte_of[c] for c in (self._tokenizer.id_to_token(i) or "") if c in byte_of) for i in range(size)])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces(Vocabulary):
    """A piece vocabulary, which puts a blank before each text itself."""

    def __init__(self, vocabulary: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=_place(vocabulary))
        piece = self._model.id_to_piece
        self._set([bytes([int(piece(i)[3:5], 16)]) if self._model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self._model.vocab_size())])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers_of(a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


#: Characters that some definition of white space holds and another does not; no cut follows them.
_UNSURE = "\x1c\x1d\x1e\x1f\u180e\u200b\u2060\ufeff"


def _ends_open(word: str) -> bool:
    """Whether no cut may follow: the word is empty, or ends in white space by any definition."""
    return not word or word[-1].isspace() or word[-1] in _UNSURE


def segments(text: str) -> list[str]:
    """Pieces of a text, each without the blank before it; with them they add up to blank + text."""
    out, open_words = [], []
    words = text.split(" ")
    for k, word in enumerate(words):
        open_words.append(word)
        if not _ends_open(word) and not (k == len(words) - 2 and not words[-1]):
            out.append(" ".join(open_words))
            open_words = []
    if open_words:
        out.append(" ".join(open_words))
    return out


@dataclass
class Aligned:
    """What a batch's documents come to: segment numbers, and where each document's begin (none: no tokens)."""

    segment: np.ndarray
    starts: np.ndarray


class Aligner:
    """Aligns segments and remembers them. ``sums`` has the counts of each segment; ``pair``, ``times`` and ``at`` its links."""

    def __init__(self, a: str = VOCABULARY_A, b: str = VOCABULARY_B):
        self.a, self.b = tokenizers_of(a, b)
        self._forget()

    def _forget(self) -> None:
        self.size = 0
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.good: list[bool] = []
        self.sums, self.pair, self.times, self.at = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Align segments and number them on. Many are encoded in one text, as tokens end where segments do."""
        alone = [k for k, key in enumerate(new) if _ends_open(key) or len(key) >= LONGEST_CACHED]
        out = set(alone)
        many = [k for k in range(len(new)) if k not in out]
        runs = [many[k : k + JOINED] for k in range(0, len(many), JOINED)] + [[k] for k in alone]
        good: list[list[int]] = []
        ids: list[tuple[list[int], list[int]]] = []
        while runs:
            texts = [" ".join(new[k] for k in run) for run in runs]
            again = []
            for run, text, a, b in zip(runs, texts, self.a.ids([f" {t}" for t in texts]), self.b.ids(texts), strict=True):
                raw = f" {text}".encode()
                if b"".join(map(self.a.bytes_of.__getitem__, a)) == raw == b"".join(map(self.b.bytes_of.__getitem__, b)):
                    good.append(run)
                    ids.append((a, b))
                elif len(run) > 1:
                    again += [[k] for k in run]
            runs = again
        order = [k for run in good for k in run]
        sums, groups, pairs = self._linked([len(new[k].encode()) + 1 for k in order], np.array([x for a, _ in ids for x in a], np.int64), np.array([x for _, b in ids for x in b], np.int64))
        every_sum, every_group, is_good = np.zeros((len(new), 4), np.int64), [b""] * len(new), [False] * len(new)
        every_sum[order] = sums
        for k, text in zip(order, groups, strict=True):
            every_group[k], is_good[k] = text, True
        segment, pair, times = np.array(order, np.int64)[pairs[0]], pairs[1], pairs[2]
        place = np.argsort(segment, kind="stable")
        self.groups += every_group
        self.good += is_good
        self.sums = np.concatenate([self.sums, every_sum])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(segment, minlength=len(new)))])
        self.pair, self.times = np.concatenate([self.pair, pair[place]]), np.concatenate([self.times, times[place]])
        self.size += 200 * len(new) + sum(map(len, every_group)) + 16 * len(pair)

    def _linked(self, lengths: list[int], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts, groups, and (segment, pair, times) of segments of some lengths that both token sequences add up to.

        A link is a stretch between neighbouring ends of either side, a group one between ends that both have.
        """
        if not lengths:
            return np.zeros((0, 4), np.int64), [], (np.zeros(0, np.int64),) * 3
        end, n = np.cumsum(lengths), len(lengths)
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        either, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        if not np.isin(end, both, assume_unique=True).all():
            raise ValueError("a token goes over the end of a segment")
        of = [np.searchsorted(end, x) for x in (end_a, end_b, both, either)]
        pair = a[np.searchsorted(end_a, either)] << ID_BITS | b[np.searchsorted(end_b, either)]
        link, times = np.unique(of[3] << 2 * ID_BITS | pair, return_counts=True)
        # the groups as text: a part for each token, in the order of (group, side)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        text_a = np.where(last_a, self.a.text["|"][a], self.a.text[","][a])
        ends = end[of[1]] == end_b
        text_b = np.where(ends, self.b.text["\n"][b], np.where(last_b, self.b.text[";"][b], self.b.text[","][b]))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        groups = "".join(np.concatenate([text_a, text_b])[order].tolist()).encode().split(b"\n")[:-1]
        sums = np.stack([np.bincount(x, minlength=n) for x in of], axis=1)
        return sums, groups, (link >> 2 * ID_BITS, link & ((1 << 2 * ID_BITS) - 1), times)

    def align(self, texts: list[str | None]) -> Aligned:
        """Segment numbers of texts. Numbers hold until the next call."""
        if self.size > CACHED_BYTES:
            self._forget()
        keep, local, new = self.number, {}, []
        numbers: list[list[int]] = []

        def number(key: str) -> int:
            """A segment's number; new ones are numbered on and aligned at the end. Long ones are not remembered."""
            where = keep if len(key) < LONGEST_CACHED and not _ends_open(key) else local
            found = where.get(key)
            if found is None:
                found = where[key] = len(self.groups) + len(new)
                new.append(key)
            return found

        for text in texts:
            if not text:
                numbers.append([])
                continue
            words = text.split(" ")
            found = list(map(keep.get, words))  # words that are not segments of their own are never kept
            if not words[-1]:
                found = [number(key) for key in segments(text)]
            elif None in found:
                missing = [word for word, known in zip(words, found, strict=True) if known is None]
                if any(len(word) >= LONGEST_CACHED or _ends_open(word) for word in missing):
                    found = [number(key) for key in segments(text)]
                else:
                    for word in missing:
                        number(word)
                    found = list(map(keep.get, words))
            numbers.append(found)
        if new:
            self._learn(new)
        if False in self.good:
            numbers = [n if all(map(self.good.__getitem__, n)) else [] for n in numbers]
        lengths = np.array([len(n) for n in numbers], np.int64)
        return Aligned(np.fromiter(chain.from_iterable(numbers), np.int64, int(lengths.sum())), np.concatenate([[0], np.cumsum(lengths)]))

    def digest(self, segment: np.ndarray) -> str:
        """SHA-256 of the groups of one document; empty without tokens."""
        if not len(segment):
            return ""
        out = hashlib.sha256()
        for k in range(0, len(segment), HASHED):
            out.update((b";" if k else b"") + b";".join(map(self.groups.__getitem__, segment[k : k + HASHED].tolist())))
        return out.hexdigest()

    def totals(self, of: Aligned) -> np.ndarray:
        """A row for each document: n_a, n_b, n_groups, n_links."""
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sums[of.segment], axis=0)])
        return running[of.starts[1:]] - running[of.starts[:-1]]

    def postings(self, of: Aligned, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed (pair, document) and multiplicity, in order; documents are numbered from ``first``."""
        low = np.repeat(np.arange(first, first + len(of.starts) - 1), np.diff(of.starts))
        seen, often = np.unique(low << 32 | of.segment, return_counts=True)
        segment, low = seen & 0xFFFFFFFF, seen >> 32
        many = self.at[segment + 1] - self.at[segment]
        link = np.repeat(self.at[segment] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return summed((self.pair[link] << 16) | np.repeat(low, many), self.times[link] * np.repeat(often, many))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


# Bitmaps of the numbers below 2 ** 16: a tag, then sorted numbers or bits, whichever is shorter.


NUMBERS, BITS = b"\0", b"\1"
EMPTY = NUMBERS


def bitmap(numbers: np.ndarray) -> bytes:
    """A bitmap of distinct numbers in order."""
    if len(numbers) and 2 * len(numbers) > int(numbers[-1]) // 8 + 1:
        bits = np.zeros(int(numbers[-1]) // 8 * 8 + 8, np.uint8)
        bits[numbers] = 1
        return BITS + np.packbits(bits, bitorder="little").tobytes()
    return NUMBERS + numbers.astype("<u2").tobytes()


def members(found: bytes) -> np.ndarray:
    """The numbers of a bitmap, in order."""
    if found[:1] == BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(found, "<u2", offset=1).astype(np.int64)


def population(found: bytes) -> int:
    return int.from_bytes(found[1:], "little").bit_count() if found[:1] == BITS else (len(found) - 1) // 2


def or_merged(found: list[bytes]) -> bytes:
    """The bitmap of all numbers that are in any of some bitmaps."""
    if len(found) == 1:
        return found[0]
    if all(x[:1] == BITS for x in found):
        return BITS + np.bitwise_or.reduce([np.frombuffer(x[1:].ljust(max(map(len, found)) - 1, b"\0"), np.uint8) for x in found]).tobytes()
    return bitmap(np.unique(np.concatenate([members(x) for x in found])))


def run_of(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, list[bytes], list[list[bytes]]]:
    """Packed pairs in order, and for each the bitmap of its documents and its planes."""
    pair, low = keys >> 16, keys & 0xFFFF
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(keys))
    docs = [bitmap(low[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
    planes: list[list[bytes]] = [[] for _ in docs]
    of, extra, k = np.repeat(np.arange(len(first)), ends - first), times - 1, 0
    while len(extra) and extra.any():
        held = extra > 0
        of, low, extra = of[held], low[held], extra[held]
        odd = (extra & 1) == 1
        for which in np.unique(of).tolist():
            planes[which].append(EMPTY)
        inside, lows = of[odd], low[odd]
        if len(inside):
            begins = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
            for which, s, e in zip(inside[begins].tolist(), begins.tolist(), np.append(begins[1:], len(inside)).tolist(), strict=True):
                planes[which][k] = bitmap(lows[s:e])
        extra, k = extra >> 1, k + 1
    return pair[first], docs, planes


def _indexer(id_field: StructField, a: str, b: str):
    """Documents to rows of the index: runs of postings, and a row with the counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, low = Aligner(a, b), TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0

        def posted(id_type: pa.DataType) -> pa.RecordBatch:
            pair, docs, planes = run_of(*summed(np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held])))
            n = len(docs)
            columns = {
                "id": pa.nulls(n, id_type), "kind": pa.array(np.full(n, POSTING, np.int8)), "block": pa.array(np.full(n, block)),
                "a": pa.array((pair >> ID_BITS).astype(np.int32)), "b": pa.array((pair & ((1 << ID_BITS) - 1)).astype(np.int32)), "docs": pa.array(docs, pa.binary()), "planes": pa.array(planes, pa.list_(pa.binary())),
                "low": pa.nulls(n, pa.int32()), **{c: pa.nulls(n, pa.int64()) for c in COUNTS}, "groups_sha256": pa.nulls(n, pa.string()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                if low == BLOCK_DOCS:
                    if held:
                        yield posted(whole["id"].type)
                    held, pending, block, low = [], 0, block + 1, 0
                batch = whole.slice(at, BLOCK_DOCS - low)
                n, at = batch.num_rows, at + batch.num_rows
                found = aligner.align(batch["text"].to_pylist())
                totals = aligner.totals(found)
                digests = [aligner.digest(found.segment[s:e]) for s, e in zip(found.starts[:-1], found.starts[1:], strict=True)]
                columns = {
                    "id": batch["id"], "kind": pa.array(np.full(n, DOCUMENT, np.int8)), "block": pa.array(np.full(n, block)), "a": pa.nulls(n, pa.int32()), "b": pa.nulls(n, pa.int32()),
                    "docs": pa.nulls(n, pa.binary()), "planes": pa.nulls(n, pa.list_(pa.binary())), "low": pa.array(np.arange(low, low + n, dtype=np.int32)),
                    **{c: pa.array(totals[:, k]) for k, c in enumerate(COUNTS)}, "groups_sha256": pa.array(digests, pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)
                keys, times = aligner.postings(found, low)
                low += n
                if len(keys):
                    held.append((keys, times))
                    pending += len(keys)
                if pending > RUN_POSTINGS:
                    yield posted(batch["id"].type)
                    held, pending = [], 0
        if held:
            yield posted(whole["id"].type)

    return run


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Written rows of both kinds: postings (block, a, b, docs, planes), and documents (id, block, low, counts)."""
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = StructField("id", slim.schema["id"].dataType)
    return written(slim.mapInArrow(_indexer(field, a, b), StructType([field, *StructType.fromDDL(INDEX).fields])), "alignment")


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (a, b, block) to one row for each, with populations. Holds the runs of one pair and block."""
    names = ["a", "b", "block", "docs", "planes", "n_docs", "n_links"]
    key, docs, planes = None, [], []

    def row() -> tuple:
        every = or_merged(docs)
        digits = [or_merged([p[k] for p in planes if k < len(p)]) for k in range(max(map(len, planes)))]
        n = population(every)
        return (*key, every, digits, n, n + sum(population(p) << k for k, p in enumerate(digits)))

    for batch in batches:
        out = []
        for *new, found, digits in zip(*(batch[c].to_pylist() for c in names[:5]), strict=True):
            if new != key:
                if key:
                    out.append(row())
                key, docs, planes = new, [], []
            docs.append(found)
            planes.append(digits)
        if out:
            yield _as_batch(out, names)
    if key:
        yield _as_batch([row()], names)


def _as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def merged_postings(found: DataFrame) -> DataFrame:
    """One row for each (a, b, block): docs, planes, n_docs, n_links. Written. Also merges the indexes of several tables, if their blocks differ."""
    runs = found.where(F.col("kind") == POSTING).select("a", "b", "block", "docs", "planes")
    ordered = runs.repartition("a", "b", "block").sortWithinPartitions("a", "b", "block")
    return written(ordered.mapInArrow(_merge_runs, "a int, b int, block long, docs binary, planes array<binary>, n_docs long, n_links long"), "postings")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) of each linked pair of ids; best: no pair of its a is in more documents. At most |A| times |B| rows."""
    counts = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    # the window of an A id holds at most one row for each id of B
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def add(total: np.ndarray, best: np.ndarray, postings: pa.RecordBatch) -> None:
    """Add pairs' counts, as often as the planes say, to the documents in their bitmaps."""
    number, low, row, weight = 0, [], [], []

    def flush() -> None:
        if low:
            lows, sizes = np.concatenate(low), [len(x) for x in low]
            rows, weights = np.repeat(row, sizes), np.repeat(weight, sizes)
            np.add.at(total, lows, counts[rows] * weights)
            np.add.at(best, lows, is_best[rows] * weights)

    counts, is_best = postings["n_docs"].to_numpy(), postings["best"].to_numpy(zero_copy_only=False).astype(np.int64)
    for k, (docs, planes) in enumerate(zip(postings["docs"].to_pylist(), postings["planes"].to_pylist(), strict=True)):
        for digit, found in enumerate([docs, *planes]):
            low.append(members(found))
            row.append(k)
            weight.append(1 << max(0, digit - 1))
            number += len(low[-1])
        if number > ADDED:
            flush()
            number, low, row, weight = 0, [], [], []
    flush()


def _add_up(id_name: str):
    """Postings of a block, then its documents, to scored documents. Holds two numbers for each document of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, best = None, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
        for whole in batches:
            blocks = whole["block"].to_numpy()
            for s, e in _stretches(blocks):
                if blocks[s] != current:
                    current = blocks[s]
                    total[:], best[:] = 0, 0
                batch = whole.slice(s, e - s)
                n = int((batch["kind"].to_numpy() == POSTING).sum())  # they come first
                add(total, best, batch.slice(0, n))
                rest = batch.slice(n)
                if rest.num_rows:
                    low = rest["low"].to_numpy()
                    columns = [rest["id"], *(rest[c] for c in COUNTS), pa.array(best[low]), pa.array(total[low]), rest["groups_sha256"]]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_name, *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return run


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of stretches of equal neighbours."""
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
    return list(zip(edges, edges[1:], strict=False))


def scored(found: DataFrame, postings: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document with its counts, n_best and count_sum: postings go back to their documents, block by block."""
    returned = postings.join(counts.select("a", "b", F.col("n_docs").alias("count"), "best"), ["a", "b"]).select(
        F.lit(POSTING).cast("byte").alias("kind"), "block", "docs", "planes", F.col("count").alias("n_docs"), "best"
    )
    own = found.where(F.col("kind") == DOCUMENT).select("kind", "block", "id", "low", *COUNTS, "groups_sha256")
    together = returned.unionByName(own, allowMissingColumns=True)
    ordered = together.repartition("block").sortWithinPartitions("block", "kind")
    kind = own.schema["id"].dataType.simpleString()
    return ordered.mapInArrow(_add_up(id_col), f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document. ``pair_counts`` has the pairs."""
    found = index(df, id_col, text_col, a, b)
    postings = merged_postings(found)
    return scored(found, postings, pair_counts(postings), id_col)


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir).select("doc_id", "text"))
