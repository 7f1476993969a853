"""Language identification of words with a linear-chain conditional random field.

A word's features are its affixes (1 to 3 characters at either end), its inner
character n-grams (1 to 3) and, for frequent training words, the word itself (the
lexicon). Emission weights of hashed features and a transition matrix are learned
by maximum likelihood: the gradient of the chain's log-likelihood comes from
forward-backward marginals. Training documents carry one label each; chains are
made by joining pieces of documents of different labels, so that transitions
learn how seldom, but not never, the language changes inside a text.

A text is labelled by running forward-backward over all its words; the score of
a language is the mean of its word marginals, and the best one is predicted. In
code-switched texts ``word_languages`` gives each word its own label. Marginals
are relative to the learned languages; how much the field knows of a text at all
is its ``evidence``, the mean lead of a word's best label over the labels' mean.

Training is bounded: at most ``per_label`` documents of each label, the ones
with the least hash of id, none longer than ``LONGEST`` characters; each is used
whole. Prediction is whole-text: a text of more than ``PIECE`` words runs as
pieces side by side. The messages that enter a piece at either end are products
of the other pieces' matrices, so the result is that of the whole chain.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
null labels are not learned from; a null id counts as not held out; without
training rows every text is ``und``; a run of more than 40 letters is several
words; repeated rows get equal results; an empty table gives an empty result.
Added columns start with ``__tf_``; columns of ``df`` with these names are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyflow.llm._common import bounded_batches, by_batch, documents, schema_with

#: Documents of each label to learn from.
PER_LABEL = 120
#: Characters of the longest document to learn from.
LONGEST = 100_000
#: Rows of the hashed feature table.
FEATURE_BITS = 17
FEATURES = 1 << FEATURE_BITS
LEXICON_MIN = 3
ROUNDS = 30
#: Words of a chain that run in one row.
PIECE = 512
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]{1,40}")


def feature_table(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed feature) pairs of a list of words, in columns.

    Affixes and n-grams are hashed from code points for all words at once.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(("".join(words) + "   ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = sizes[owner]
    owners, hashes, gram = [], [], np.zeros(len(owner), np.uint64)
    for k in (1, 2, 3):
        gram = gram * np.uint64(0x100000001B3) + codes[k - 1 : k - 1 + len(owner)] + np.uint64(k)
        inner = place + k <= size
        for kind, chosen in ((1, inner), (2, inner & (place == 0)), (3, place + k == size)):
            owners.append(owner[chosen])
            hashes.append((gram[chosen] * np.uint64(4) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FEATURE_BITS))
    known = [(i, zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES) for i, w in enumerate(words) if w in lexicon]
    owners.append(np.array([i for i, _ in known], np.int64))
    hashes.append(np.array([f for _, f in known], np.uint64))
    return np.concatenate(owners), np.concatenate(hashes).astype(np.int64)


def word_scores(weights: np.ndarray, owner: np.ndarray, feature: np.ndarray, words: int) -> np.ndarray:
    """Summed feature weights of each word: (words, labels)."""
    return np.stack([np.bincount(owner, weights[feature, j], minlength=words) for j in range(weights.shape[1])], axis=1)


def words_in(text: str | None) -> list[str]:
    """Lower-cased words; none if there is no letter (number signs alone are no words)."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Forward-backward over padded chains.

    emission: (chains, steps, labels) scores. ``enter`` and ``leave`` are the
    messages that reach a chain's first word from before and its last word from
    after (else ``start`` and ones). Returns word marginals of that shape,
    expected transitions summed over all chains, and log partitions.
    """
    chains, steps, labels = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - top)
    move = np.exp(transition)
    forward, scale = np.empty_like(e), np.ones((chains, steps))
    live = np.arange(steps)[None, :] < lengths[:, None]
    a = (np.exp(start)[None, :] if enter is None else enter) * e[:, 0]
    for t in range(steps):
        if t:
            a = np.where(live[:, t, None], (a @ move) * e[:, t], a)
        s = np.where(live[:, t], a.sum(axis=1), 1.0)
        a = a / s[:, None]
        forward[:, t], scale[:, t] = a, s
    out = np.zeros_like(e)
    b, moved = np.ones((chains, labels)) if leave is None else leave, np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        g = forward[:, t] * b
        out[:, t] = np.where(live[:, t, None], g / g.sum(axis=1, keepdims=True), 0)
        if t:
            eb = np.where(live[:, t, None], e[:, t] * b / scale[:, t, None], 0)
            moved += forward[:, t - 1].T @ eb
            b = np.where(live[:, t, None], eb @ move.T, b)
    log_z = (np.log(scale) * live).sum(axis=1) + (top[:, :, 0] * live).sum(axis=1)
    return out, moved * move, log_z


def products_of(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The matrix by which each piece of a long chain acts on a message: the product over its
    words, which all pieces build step by step side by side."""
    _, steps, labels = emission.shape
    e, move = np.exp(emission - emission.max(axis=2, keepdims=True)), np.exp(transition)
    product = np.eye(labels)[None] * e[:, 0, None, :]
    for t in range(1, steps):
        product = np.where((t < lengths)[:, None, None], (product @ move) * e[:, t, None, :], product)
        product /= product.max(axis=(1, 2), keepdims=True)
    return product


def joined(product: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters and what leaves each piece of one long chain: (pieces, labels) twice."""
    pieces, labels, _ = product.shape
    move = np.exp(transition)
    enter, leave = np.empty((pieces, labels)), np.ones((pieces, labels))
    v = np.exp(start)
    for p in range(pieces):
        enter[p] = v / v.sum()
        v = enter[p] @ product[p] @ move
    for p in range(pieces - 1, 0, -1):
        b = move @ (product[p] @ leave[p])
        leave[p - 1] = b / b.sum()
    return enter, leave


@dataclass
class Model:
    labels: list[str]
    lexicon: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0), np.float32))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Evidence below which a text is in none of the learned languages.
    least_evidence: float = 0.0

    def emissions(self, words: list[str]) -> np.ndarray:
        return word_scores(self.weights, *feature_table(words, self.lexicon), len(words))


def train(texts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Fit the field on labelled texts by full-batch gradient steps with per-weight rates."""
    names = sorted(set(labels))
    if not names:
        return Model([])
    rng = np.random.default_rng(seed)
    pieces = []
    for text, label in zip(texts, labels, strict=True):
        words = words_in(text)
        for at in range(0, len(words), 25):
            pieces.append((names.index(label), words[at : at + 25]))
    if not pieces:
        return Model([])
    counts: dict[str, int] = {}
    for _, words in pieces:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_MIN)
    number = {w: i for i, w in enumerate(counts)}
    owner, feature = feature_table(list(number), lexicon)

    # Pieces in any order: changes of language in every direction, about every 30 words.
    order = rng.permutation(len(pieces))
    chains = [[pieces[j] for j in order[i : i + 4]] for i in range(0, len(order), 4)]
    steps, k = max(sum(len(w) for _, w in c) for c in chains), len(names)
    ids, gold, lengths = np.zeros((len(chains), steps), np.int64), np.zeros((len(chains), steps), np.int64), np.zeros(len(chains), np.int64)
    for c, chain in enumerate(chains):
        for label, words in chain:
            ids[c, lengths[c] : lengths[c] + len(words)] = [number[w] for w in words]
            gold[c, lengths[c] : lengths[c] + len(words)] = label
            lengths[c] += len(words)
    live = np.arange(steps)[None, :] < lengths[:, None]
    truth = (np.eye(k)[gold]) * live[:, :, None]
    both = live[:, 1:]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)

    model = Model(names, lexicon, np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k))
    rates = [np.full_like(x, 1e-6) for x in (model.weights, model.transition, model.start)]
    total = live.sum()
    for _ in range(rounds):
        by_word = word_scores(model.weights, owner, feature, len(number))
        word_p, moved, _ = marginals(by_word[ids], lengths, model.transition, model.start)
        left = (truth - word_p).reshape(-1, k)
        per_word = np.stack([np.bincount(ids.ravel(), left[:, j], minlength=len(number)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(feature, per_word[owner, j], minlength=FEATURES) for j in range(k)], axis=1)
        steps_of = [gradient / total - 1e-7 * model.weights, (gold_moves - moved) / total, (truth[:, 0] - word_p[:, 0]).sum(axis=0) / total]
        for value, rate, step in zip((model.weights, model.transition, model.start), rates, steps_of, strict=True):
            rate += step * step
            value += 0.3 * step / np.sqrt(rate)
    model.weights = model.weights.astype(np.float32)
    # Half of what one training stretch of five words in a thousand falls short of.
    lead = leads(word_scores(model.weights, owner, feature, len(number)))
    flat = lead[np.concatenate([[number[w] for w in words] for _, words in pieces])]
    if len(flat) >= 5:
        fives = flat[: len(flat) // 5 * 5].reshape(-1, 5).mean(axis=1)
        model.least_evidence = float(np.quantile(fives, 0.001) / 2)
    return model


def leads(scores: np.ndarray) -> np.ndarray:
    """How far each word's best label is above the labels' mean."""
    return scores.max(axis=1) - scores.mean(axis=1)


class Tagger:
    """Labels batches of texts; emission scores of words seen are kept, up to a bound."""

    def __init__(self, model: Model, keep: int = 500_000, cells: int = 400_000, piece: int = PIECE):
        self.model, self.keep, self.cells, self.piece = model, keep, cells, piece
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.labels)), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        known, new = self.known, []
        for w in words:
            if w not in known:
                known[w] = len(known)
                new.append(w)
        if new:
            if len(known) > len(self.scores):
                grown = np.zeros((max(2 * len(self.scores), len(known)), self.scores.shape[1]), np.float32)
                grown[: len(self.scores)] = self.scores
                self.scores = grown
            self.scores[len(known) - len(new) : len(known)] = self.model.emissions(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _padded(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in parts])
        ids = np.zeros((len(parts), lengths.max()), np.int64)
        for row, x in enumerate(parts):
            ids[row, : len(x)] = x
        return self.scores[ids], lengths

    def means(self, texts: list[str | None]) -> list[tuple[np.ndarray, float] | None]:
        """Mean word marginals and evidence of each text; None where it has no letter."""
        out: list[tuple[np.ndarray, float] | None] = [None] * len(texts)
        model = self.model
        if not model.labels:
            return out
        if len(self.known) > self.keep:
            self.known = {}
        found = [(i, words) for i, t in enumerate(texts) if (words := words_in(t))]
        if not found:
            return out
        numbers, ends = self._numbers([w for _, words in found for w in words]), np.cumsum([len(words) for _, words in found])
        # Each text is one piece or several; pieces of like length run side by side, whatever text they are of.
        parts, owner = [], []
        for (i, words), end in zip(found, ends.tolist(), strict=True):
            for at in range(end - len(words), end, self.piece):
                parts.append(numbers[at : min(at + self.piece, end)])
                owner.append(i)
        enter, leave = self._messages(parts, owner)
        sums, lead = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
        for group in self._groups(parts, range(len(parts))):
            emission, lengths = self._padded([parts[p] for p in group])
            p, _, _ = marginals(emission, lengths, model.transition, model.start, enter[group], leave[group])
            own = [owner[p] for p in group]
            np.add.at(sums, own, p.sum(axis=1))
            np.add.at(lead, own, (leads(emission.reshape(-1, emission.shape[2])).reshape(emission.shape[:2]) * (np.arange(emission.shape[1]) < lengths[:, None])).sum(axis=1))
        for i, words in found:
            out[i] = sums[i] / len(words), float(lead[i] / len(words))
        return out

    def _groups(self, parts: list[np.ndarray], chosen) -> list[list[int]]:
        """Pieces of like length, as many as fit the padded cells."""
        out: list[list[int]] = []
        for p in sorted(chosen, key=lambda p: len(parts[p])):
            if out and (len(out[-1]) + 1) * len(parts[p]) <= self.cells:
                out[-1].append(p)
            else:
                out.append([p])
        return out

    def _messages(self, parts: list[np.ndarray], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """What enters and what leaves each piece; a text of one piece needs no product."""
        model = self.model
        enter = np.repeat(np.exp(model.start)[None, :], len(parts), axis=0)
        leave = np.ones_like(enter)
        runs = np.flatnonzero(np.append(True, np.diff(owner) != 0))
        several = [(a, b) for a, b in zip(runs, [*runs[1:], len(parts)], strict=True) if b - a > 1]
        products = np.empty((len(parts), *model.transition.shape))
        for group in self._groups(parts, [p for a, b in several for p in range(a, b)]):
            products[group] = products_of(*self._padded([parts[p] for p in group]), model.transition)
        for a, b in several:
            enter[a:b], leave[a:b] = joined(products[a:b], model.transition, model.start)
        return enter, leave


_taggers: dict[int, Tagger] = {}


def tagger_of(shared) -> Tagger:
    """The worker's tagger of a broadcast model; it outlives a task, so words seen stay known."""
    if id(shared.value) not in _taggers:
        _taggers.clear()
        _taggers[id(shared.value)] = Tagger(shared.value)
    return _taggers[id(shared.value)]


def word_languages(model: Model, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its most likely language."""
    words = words_in(text)
    if not words or not model.labels:
        return []
    emission = model.emissions(words)[None]
    p, _, _ = marginals(emission, np.array([len(words)]), model.transition, model.start)
    return [(w, model.labels[j]) for w, j in zip(words, p[0].argmax(axis=1).tolist(), strict=True)]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL) -> Model:
    """Train on a bounded sample of the rows that are not held out."""
    bounded_batches(df.sparkSession)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= LONGEST) & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("label"), F.xxhash64(F.col(id_col)).alias("draw"), F.col(text_col).alias("text")
    )
    # Hashes are uniform: a share of each label's rows holds the least ones, and only those are ranked.
    chosen = F.lit(False)
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        share = min(1.0, (2 * per_label + 200) / r["n"])
        chosen = chosen | ((F.col("label") == r["label"]) & (F.col("draw") <= int(-(2**63) + share * (2**64 - 2**12))))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "text"))
    sample = rows.where(chosen).withColumn("place", place).where(F.col("place") <= per_label).orderBy("draw", "label", "text").collect()
    return train([r.text for r in sample], [r.label for r in sample])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with __tf_lang, __tf_score and __tf_evidence."""
    bounded_batches(df.sparkSession)
    df = df.drop("__tf_lang", "__tf_score", "__tf_evidence")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tagger = tagger_of(shared)
        means = tagger.means(batch[text_col].to_pylist())
        names = [UNKNOWN if m is None else tagger.model.labels[int(m[0].argmax())] for m in means]
        scores = [0.0 if m is None else float(min(1.0, m[0].max())) for m in means]
        evidence = [0.0 if m is None else m[1] for m in means]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())], names=[*batch.schema.names, "__tf_lang", "__tf_score", "__tf_evidence"]
        )

    return df.mapInArrow(by_batch(run), schema_with(df, "__tf_lang string, __tf_score double, __tf_evidence double"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__tf_lang").alias("lang_pred"), F.col("__tf_score").alias("score"))
