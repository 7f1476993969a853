import math
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from tallyflow.llm import lm_score as lm


def test_hashed_words_have_probabilities_of_their_own(spark):
    rows = [(i, f"top w{i} W{i % 40} v{i % 7} w{i}\x0bü{i % 3}") for i in range(600)] + [(7, "top w7 W7 v0 w7\x0bü1"), (None, None), (601, ""), (602, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = df.where("doc_id < 600")
    counts = Counter(w for i, t in rows[:601] for w in t.encode().lower().split() if w != b"top")
    totals = Counter()
    for w, n in counts.items():
        totals[zlib.crc32(w) % lm.HASHED] += n
    model = ([b"top"], lm.Network.fresh().flat)
    by_id = {r.doc_id: r.log_prob for r in lm.score(df, model).collect()}
    got = lm.score(df, model, counts=lm.word_counts(held)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (dict(rows)[r.doc_id] or "").encode().lower().split()
        shares = sum(math.log(counts.get(w, 1) / (totals[zlib.crc32(w) % lm.HASHED] + 1)) for w in words if w != b"top")
        assert r.n_tokens == len(words)
        assert r.log_prob == pytest.approx(by_id[r.doc_id] + shares, rel=1e-6)
        assert r.mean_log_prob == pytest.approx(r.log_prob / max(1, len(words)))


def test_words_are_cut_at_ascii_blanks_only():
    texts = [None, "", " \x0b\n", "A b\tC\r\n d", "\x1cx\x1f y Z   q", " Ää\x0c\x00 e "]
    words, sizes = lm.split_words(pa.array(texts))
    expected = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == list(map(len, expected))
    assert words.to_pylist() == [w for own in expected for w in own]
