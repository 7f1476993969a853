"""Document scores by masked pseudo-likelihood.

A small bidirectional window network in numpy predicts every word from the two
words on either side of it: their embeddings, weighted by place, are added and
squashed, and a two-level softmax gives the probability of the word's class and
of the word in its class. A document's score is the sum of the conditional
log-probabilities of all its words. The most frequent words have ids of their
own; a hashed word has the probability of its id times its share in the counts
of all words of that id, which are joined on the words in Spark. Words that were
never counted have, for each id, the share of one.

From the corpus come the word counts of all documents (summed map-side first)
and the weights. Every word is masked and learned from once over the ``ROUNDS``
rounds: stretches of ids with two neighbours on either side are written once, and
which round and learner gets a stretch follows from hashes of the rows. In each
round every learner goes on from the shared weights with stochastic steps over its
stretches in hash order, and the learners' weights are averaged. There are as many
learners as the number of words asks for, ``LEARNERS`` at most (then each takes
more steps), so results do not depend on how the input is partitioned. The average
is taken chunk by chunk in Spark; only the finished weights, of fixed size, reach
the driver.

Defined cases: null and blank texts have no tokens and score 0; a null id stays
null; repeated rows get equal scores but for rounding; an empty table gives an empty result and an
untrained network; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, documents, written

CLASSES = 64
IN_CLASS = 64
VOCABULARY = CLASSES * IN_CLASS
#: Ids that words outside the vocabulary share; id 0 stands beyond the ends of a text.
HASHED = 256
WIDTH = 16
SIDE = (-2, -1, 1, 2)
ROUNDS = 4
CHUNKS = 64
RATE = 0.08
#: Masked words in one gradient step, and in one learner's part of a round.
STEP = 8192
LEARNER = 1_200_000
#: Learners of a round at most; each sends weights of half a megabyte.
LEARNERS = 4096
#: Words of a text that are learned from together.
STRETCH = 1 << 16
#: Bound of the logits below which their exponentials need no scaling.
PLAIN = 60.0
#: Words scored at once.
SCORED = 16384
#: Words a task counts before it sends what it has.
COUNTED = 4_000_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts (binary), and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # blanks at the ends of a text leave empty words
    sizes = np.bincount(pc.list_parent_indices(lists).filter(real).to_numpy(), minlength=len(texts))
    return words.filter(real).cast(pa.binary() if pa.types.is_string(words.type) else pa.large_binary()), sizes


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        held, n = [], 0
        for batch in batches:
            held.append(split_words(batch["text"])[0].cast(pa.binary()))
            n += len(held[-1])
            if n > COUNTED:
                yield rows()
                held, n = [], 0
        yield rows()

    bounded_batches(df.sparkSession)
    return df.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, k: int) -> list[bytes]:
    """The ``k`` most frequent words, ties in byte order.

    A histogram of the counts tells from which count on the words are wanted, so
    that tasks send the driver about ``k`` words in all, not ``k`` each.
    """
    counts = counts.withColumn("level", F.floor(F.log2("n") * 8))
    levels = sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.level)
    least, total = 0, 0
    for r in levels:
        least, total = r.level, total + r.words
        if total >= k:
            break
    top = counts.where(F.col("level") >= least).orderBy(F.desc("n"), "word").limit(k).collect()
    return [bytes(r.word) for r in sorted(top, key=lambda r: (-r.n, bytes(r.word)))]


class WordIds(dict):
    """Word to id; words outside the vocabulary are hashed, and kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        number = VOCABULARY - HASHED + zlib.crc32(word) % HASHED
        if len(self) < 500_000:
            self[word] = number
        return number

    @staticmethod
    def of(frequent: list[bytes]) -> WordIds:
        return WordIds({w: i + 1 for i, w in enumerate(frequent[: VOCABULARY - HASHED - 1])})


def log_softmax(z: np.ndarray, chosen: np.ndarray, with_all: bool, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of the chosen column of each row, and (if asked for) all probabilities; ``z``, whose size ``bound`` limits, is used up."""
    if bound > PLAIN:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if with_all:
        z /= total[:, None]
    return own - np.log(total), z


def by_word(words: np.ndarray) -> np.ndarray:
    """Places in the order of their words; numpy sorts 16-bit numbers by their digits."""
    return np.argsort(words.astype(np.uint16), kind="stable")


class Network:
    """Weights as views into one flat vector."""

    SHAPES = (("embed", (VOCABULARY, WIDTH)), ("place", (len(SIDE), WIDTH)), ("bias", (WIDTH,)), ("classes", (CLASSES, WIDTH)), ("class_bias", (CLASSES,)), ("words", (CLASSES, IN_CLASS, WIDTH)), ("word_bias", (CLASSES, IN_CLASS)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, self.tables, self.bounds, at = flat, None, None, 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        net = Network((np.random.default_rng(seed).standard_normal(Network.SIZE) * 0.1).astype(np.float32))
        net.place += 0.5
        net.class_bias[:] = 0
        net.word_bias[:] = 0
        return net

    def _placed(self) -> list[np.ndarray]:
        """Embeddings weighted for each place beside a word; only for weights that no longer change."""
        if self.tables is None:
            self.tables = [self.embed * p for p in self.place]
        return self.tables

    def _logit_bounds(self) -> list[float]:
        """Bounds of the logits of classes and of words: hidden units lie between -1 and 1."""
        return [float((np.abs(w).sum(axis=-1) + np.abs(b)).max()) for w, b in ((self.classes, self.class_bias), (self.words, self.word_bias))]

    def run(self, ids: np.ndarray, at: np.ndarray, gradient: Network | None = None) -> np.ndarray:
        """Log-probability of the word at each place; adds the gradient of their sum, if one is given."""
        return self.scored(ids[at[:, None] + np.array(SIDE)], ids[at], gradient)

    def scored(self, context: np.ndarray, target: np.ndarray, gradient: Network | None = None) -> np.ndarray:
        """``run`` on words with their neighbours."""
        order = by_word(target)
        context, target = context[order], target[order]
        own, inner = target // IN_CLASS, target % IN_CLASS
        rows = np.arange(len(target))
        if gradient is None:
            tables = self._placed()
            self.bounds = limits = self.bounds or self._logit_bounds()
        else:
            tables, limits = [self.embed * p for p in self.place], self._logit_bounds()
        hidden = np.take(tables[0], context[:, 0], axis=0) + self.bias
        for table, column in zip(tables[1:], context.T[1:], strict=True):
            hidden += np.take(table, column, axis=0)
        np.tanh(hidden, out=hidden)

        z = hidden @ self.classes.T + self.class_bias
        out, z = log_softmax(z, own, gradient is not None, limits[0])
        if gradient is not None:
            dz = -z
            dz[rows, own] += 1
            gradient.classes += dz.T @ hidden
            gradient.class_bias += dz.sum(axis=0)
            back = dz @ self.classes
        bounds = np.searchsorted(own, np.arange(CLASSES + 1))
        for c in np.unique(own).tolist():
            a, b = bounds[c], bounds[c + 1]
            h = hidden[a:b]
            y = h @ self.words[c].T + self.word_bias[c]
            inner_log, y = log_softmax(y, inner[a:b], gradient is not None, limits[1])
            out[a:b] += inner_log
            if gradient is not None:
                dy = -y
                dy[np.arange(b - a), inner[a:b]] += 1
                gradient.words[c] += dy.T @ h
                gradient.word_bias[c] += dy.sum(axis=0)
                back[a:b] += dy @ self.words[c]
        if gradient is not None:
            back *= 1 - hidden * hidden
            gradient.bias += back.sum(axis=0)
            # Rows of one word are added up before they go to its place.
            for k, column in enumerate(context.T):
                by = by_word(column)
                word = column[by]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
                summed = np.add.reduceat(np.take(back, by, axis=0), first, axis=0) if len(first) else np.zeros((0, WIDTH), back.dtype)
                word = word[first]
                gradient.place[k] += (self.embed[word] * summed).sum(axis=0)
                gradient.embed[word] += summed * self.place[k]
        scores = np.empty_like(out)
        scores[order] = out
        return scores


def laid_out(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of many texts with boundaries between them, where words stand, and words of each text."""
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    gap = max(SIDE)
    starts = np.cumsum(sizes + gap) - sizes
    ids = np.zeros(int(sizes.sum() + gap * (len(own) + 1)), np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    ids[at] = np.concatenate([np.zeros(0, np.int64), *own])
    return ids, at, sizes


_WORDS = "array<struct<word: long, times: int>>"


def tokens(df: DataFrame, frequent: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (a 128-bit hash of the text), row (a hash of the row), number, ids (16-bit) and words of each row.

    ``words`` are the text's hashed words with how often they occur; a task sends them
    once for each text, so copies of a text do not multiply them.
    """
    bounded_batches(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, met = _ids_of(vocabulary), set()
        for batch in batches:
            words, sizes = split_words(batch["text"])
            words = words.dictionary_encode()
            codes, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
            of_code = np.fromiter(map(number.__getitem__, distinct), "<u2", len(distinct))
            hashes = np.zeros(len(distinct), np.uint64)
            for i in np.flatnonzero(of_code >= VOCABULARY - HASHED).tolist():
                hashes[i] = xxhash.xxh64_intdigest(distinct[i], 42)  # as Spark's ``xxhash64`` has it
            ids = of_code[codes]
            bounds = np.append(0, np.cumsum(sizes)).tolist()
            new = []
            for key in batch["key"].to_pylist():
                new.append(key not in met)
                if len(met) < 1_000_000:
                    met.add(key)
            rare = np.flatnonzero((ids >= VOCABULARY - HASHED) & np.repeat(new, sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)[rare]
            h = hashes[codes[rare]]
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))[: len(h)])
            times = np.diff(np.append(first, len(h)))
            struct = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(times.astype(np.int32))], names=["word", "times"])
            ends = np.searchsorted(owner[first], np.arange(len(sizes) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), struct, mask=pa.array([not x for x in new], pa.bool_()))
            blocks = pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], batch["row"], batch["number"], blocks, lists], names=["id", "key", "row", "number", "ids", "words"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).alias("key"), F.xxhash64(id_col, text_col).alias("row"), F.monotonically_increasing_id().alias("number"), F.col(text_col).alias("text"))
    return written(slim.mapInArrow(run, f"id long, key binary, row long, number long, ids binary, words {_WORDS}"), "tokens")


def _ids_in(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in column.to_pylist()]


_ids: dict[int, WordIds] = {}


def _ids_of(shared) -> WordIds:
    """The worker's word ids; they outlive a task."""
    if id(shared.value) not in _ids:
        _ids.clear()
        _ids[id(shared.value)] = WordIds.of(shared.value)
        _ids[-id(shared.value)] = shared.value  # held, so that its id is not used again
    return _ids[id(shared.value)]


_networks: dict[int, Network] = {}


def _network_of(shared) -> Network:
    """The worker's network of finished weights; its tables outlive a task."""
    if id(shared.value) not in _networks:
        _networks.clear()
        _networks[id(shared.value)] = Network(shared.value)  # holds the weights, so that the id is not used again
    return _networks[id(shared.value)]


_MARGIN = max(SIDE)


def stretches(held: DataFrame) -> DataFrame:
    """draw, n and ids (16-bit, with the neighbours at both ends) of each stretch of ``n`` words of a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws, sizes, blocks = [], [], []
        for seed, own in zip(batch["row"].to_numpy().view(np.uint64), batch["ids"].to_pylist(), strict=True):
            n = len(own) // 2
            around = bytes(2 * _MARGIN) + own + bytes(2 * _MARGIN)
            for i, at in enumerate(range(0, n, STRETCH)):
                part = min(STRETCH, n - at)
                draws.append(seed ^ np.uint64(i))
                sizes.append(part)
                blocks.append(around[2 * at : 2 * (at + part + 2 * _MARGIN)])
        found = _mixed(np.array(draws, np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], names=["draw", "n", "ids"])

    return held.select("row", "ids").mapInArrow(by_batch(run), "draw long, n long, ids binary")


def examples_of(block: bytes) -> np.ndarray:
    """Neighbours and word, for each word of a stretch."""
    ids = np.frombuffer(block, "<u2").astype(np.int64)
    return ids[np.arange(_MARGIN, len(ids) - _MARGIN)[:, None] + np.array((*SIDE, 0))]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round(parts: DataFrame, learners: int, flat: np.ndarray) -> np.ndarray:
    """Local steps of each learner over its stretches, then the average."""
    given = parts.sparkSession.sparkContext.broadcast(flat)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, net, held, n_held, seen = None, None, [], 0, 0
        gradient, squares = Network(np.zeros(Network.SIZE, np.float32)), None

        def step(last: bool) -> None:
            nonlocal held, n_held, seen, squares
            rows = np.concatenate(held) if held else np.zeros((0, len(SIDE) + 1), np.int64)
            upto = len(rows) if last else len(rows) // STEP * STEP
            for i in range(0, upto, STEP):
                part = rows[i : min(i + STEP, upto)]
                gradient.flat[:] = 0
                net.scored(part[:, :-1], part[:, -1], gradient)
                step = gradient.flat / len(part)
                squares += step * step
                step *= RATE
                step /= np.sqrt(squares)
                net.flat += step
                seen += len(part)
            held, n_held = [rows[upto:]], len(rows) - upto

        def finished() -> Iterator[pa.RecordBatch]:
            if learner is not None:
                step(True)
                parts = np.array_split(net.flat, CHUNKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([learner] * CHUNKS, pa.int64()), pa.array([seen] * CHUNKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "learner", "n", "part"])

        for batch in batches:
            for own, block in zip(batch["learner"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if own != learner:
                    yield from finished()
                    learner, net, held, n_held, seen = own, Network(given.value.copy()), [], 0, 0
                    squares = np.full(Network.SIZE, 1e-4, np.float32)
                held.append(examples_of(block))
                n_held += len(held[-1])
                if n_held >= 16 * STEP:
                    step(False)
        yield from finished()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:  # in the order of learners
            for chunk, n, part in zip(*(batch[c].to_pylist() for c in ("chunk", "n", "part")), strict=True):
                have = totals.setdefault(chunk, [0, 0.0])
                have[0] += n
                have[1] = have[1] + n * np.frombuffer(part, np.float32).astype(np.float64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([(t[1] / t[0]).astype(np.float32).tobytes() for t in totals.values()], pa.binary())], names=["chunk", "part"])

    dealt = parts.withColumn("learner", F.pmod(F.shiftright("draw", 20), F.lit(learners))).repartition(learners, "learner").sortWithinPartitions("learner", "draw", "ids").select("learner", "ids")
    learned = dealt.mapInArrow(learn, "chunk int, learner long, n long, part binary")
    found = sorted(learned.repartition("chunk").sortWithinPartitions("chunk", "learner").mapInArrow(add, "chunk int, part binary").collect(), key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(bytes(r.part), np.float32) for r in found]) if found else flat


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[list[bytes], np.ndarray]:
    """The frequent words and the weights learned from all documents."""
    frequent = most_frequent(counts or written(word_counts(df, text_col), "word-counts"), VOCABULARY - HASHED - 1)
    return frequent, trained(tokens(df, frequent, id_col, text_col), rounds)


def trained(held: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The weights learned from ``tokens``."""
    bounded_batches(held.sparkSession)
    part = F.pmod("draw", F.lit(rounds)).cast("int").alias("round")
    cut = written(stretches(held).select("*", part), "stretches")
    sizes = {r["round"]: r.n for r in cut.groupBy("round").agg(F.sum("n").alias("n")).collect()}
    flat = Network.fresh().flat
    for r in range(rounds):
        if sizes.get(r):
            flat = _round(cut.where(F.col("round") == r), min(LEARNERS, -(-sizes[r] // LEARNER)), flat)
    return flat


def score(
    df: DataFrame, model: tuple[list[bytes], np.ndarray], id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None, held: DataFrame | None = None
) -> DataFrame:
    """id, n_tokens, log_prob (summed) and mean_log_prob of each row.

    With the word counts each word has its own probability; without them a hashed
    word has that of its id. ``held`` are the rows' ``tokens``, if they are there.
    """
    held = tokens(df, model[0], id_col, text_col) if held is None else held
    if counts is None:
        scored, total = _scored(held, model[1], np.zeros(HASHED)), F.col("log_prob")
    else:
        known = df.sparkSession.createDataFrame([(w,) for w in model[0]], "word binary")  # of fixed size
        rare = counts.join(F.broadcast(known), "word", "left_anti")
        sums = {r.bucket: r.n for r in rare.groupBy(F.pmod(F.crc32("word"), F.lit(HASHED)).alias("bucket")).agg(F.sum("n").alias("n")).collect()}
        scored = _scored(held, model[1], np.log([sums.get(b, 0) + 1.0 for b in range(HASHED)]))
        scored = scored.join(known_shares(held, rare), "key", "left")
        total = F.col("log_prob") + F.coalesce("share", F.lit(0.0))
    return scored.select(F.col("id").alias(id_col), "n_tokens", total.alias("log_prob"), (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))


def known_shares(held: DataFrame, rare: DataFrame) -> DataFrame:
    """key (of a text) and share: summed logs of the counts of the text's hashed words."""
    # Words travel with the row's number, which takes less room in a shuffle than a hash.
    own = held.where("size(words) > 0")
    each = own.select("number", F.inline("words"))
    found = each.join(rare.where("n > 1").select(F.xxhash64("word").alias("word"), F.log("n").alias("log_n")), "word")
    summed = found.groupBy("number").agg(F.sum(F.col("times") * F.col("log_n")).alias("share"))
    # A text that was met in several tasks came along several times, each time with the same sum.
    return own.select("key", "number").join(summed, "number").groupBy("key").agg(F.max("share").alias("share"))


def _scored(held: DataFrame, flat: np.ndarray, log_totals: np.ndarray) -> DataFrame:
    """Scores of ``tokens``: a hashed word has the probability of its id, over the count of its id's words."""
    bounded_batches(held.sparkSession)
    given = held.sparkSession.sparkContext.broadcast(flat)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = _network_of(given)
        ids, at, sizes = laid_out(_ids_in(batch["ids"]))
        scores = np.concatenate([np.zeros(0), *(net.run(ids, at[i : i + SCORED]) for i in range(0, len(at), SCORED))])
        hashed = ids[at] - (VOCABULARY - HASHED)
        scores -= np.where(hashed >= 0, log_totals[np.maximum(hashed, 0)], 0.0)
        total = np.diff(np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])[np.concatenate([[0], np.cumsum(sizes)])])
        return pa.RecordBatch.from_arrays([batch["id"], batch["key"], pa.array(sizes), pa.array(total)], names=["id", "key", "n_tokens", "log_prob"])

    return held.select("id", "key", "ids").mapInArrow(by_batch(run), "id long, key binary, n_tokens long, log_prob double")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts = written(word_counts(docs), "counts")
    frequent = most_frequent(counts, VOCABULARY - HASHED - 1)
    held = tokens(docs, frequent)
    return score(docs, (frequent, trained(held)), counts=counts, held=held)
