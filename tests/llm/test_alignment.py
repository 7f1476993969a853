"""Alignment against whole-text encoding and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyflow.llm import alignment

A, B = alignment.tokenizers_of()
LINE = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def whole(text):
    """Ids of a whole text in one call each, as cuts; None without tokens."""
    if not text:
        return None
    a, b = A.ids([" " + text])[0], B.ids([text])[0]
    raw = (" " + text).encode()
    if b"".join(A.bytes_of[i] for i in a) != raw or b"".join(B.bytes_of[i] for i in b) != raw:
        return None
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    return a, b, ends(a, A.bytes_of), ends(b, B.bytes_of)


def brute(texts):
    """Rows of the contract from all pairs of tokens of each text."""
    rows, links_of, corpus = [], [], Counter()
    for text in texts:
        found = whole(text)
        links, groups = [], []
        if found:
            a, b, ea, eb = found
            sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
            links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
            cuts = sorted(set(ea) & set(eb))
            start = 0
            for cut in cuts:
                side = lambda ids, s, e, lo=start, hi=cut: ",".join(str(x) for x, p, q in zip(ids, s, e, strict=True) if lo <= p and q <= hi)
                groups.append(side(a, sa, ea) + "|" + side(b, sb, eb))
                start = cut
        links_of.append(links)
        corpus.update(set(links))
        rows.append([len(found[0]) if found else 0, len(found[1]) if found else 0, len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    top = defaultdict(int)
    for (x, _), n in corpus.items():
        top[x] = max(top[x], n)
    return [(*r[:4], sum(corpus[p] == top[p[0]] for p in links), sum(corpus[p] for p in links), r[4]) for r, links in zip(rows, links_of, strict=True)]


def run(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r[c] for c in LINE) for r in sorted(alignment.align(df, **more).collect(), key=lambda r: r.doc_id)]


TEXTS = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "naïve café — 東京 and 🙂 emoji", "tabs\tand\nlines \n here", "<|endoftext|> and <s> </s> <unk>", "▁ is no blank", "x" * 300, "word " * 500, "the the the cat",
    "foo\n", "foo\n bar", "foo\n bar", " lead", "trail　 wide", "sep\x1c x", "zero​ x", "mongol᠎ x", "  nbsp", "a\x00b \x00 c", "1234567 890", "don't we'll  I'm",
]


def test_equals_whole_text_encoding(spark):
    assert run(spark, TEXTS + TEXTS[8:12]) == brute(TEXTS + TEXTS[8:12])


def test_real_texts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    assert run(spark, [t[:3000] for t in texts]) == brute([t[:3000] for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .,\n\t  　é東'1▁<s>\x1c​᠎")), max_size=8))
def test_segments_add_up(texts):
    text = " ".join(texts)
    if text:
        own = alignment.segments(text)
        assert "".join(f" {x}" for x in own) == " " + text
        assert [i for x in A.ids([f" {x}" for x in own]) for i in x] == A.ids([" " + text])[0]
        if "▁" in text:  # such a text has no tokens, nor has one of its segments
            assert whole(text) is None and any(whole(x) is None for x in own)
        else:
            assert [i for x in B.ids(own) for i in x] == B.ids([text])[0]


@pytest.mark.parametrize("docs, postings", [(3, 2), (2, 10**6), (1 << 16, 5)])
def test_blocks_and_runs_change_nothing(spark, monkeypatch, docs, postings):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", docs)
    monkeypatch.setattr(alignment, "RUN_POSTINGS", postings)
    texts = ["the cat sat", "the the the dog", "a cat, a cat and the dog", "", "the cat sat"] * 4
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r[c] for c in LINE) for r in sorted(alignment.align(df).collect(), key=lambda r: r.doc_id)]
    assert found == brute(texts)


@given(st.lists(st.sets(st.integers(0, 65535), max_size=60), min_size=1, max_size=5), st.integers(0, 60000))
def test_bitmaps(sets, base):
    dense = {x for x in range(base, base + 400)}
    every = [*sets, dense] if base % 2 else sets
    maps = [alignment.bitmap(np.array(sorted(s), np.int64)) for s in every]
    assert [set(alignment.members(m).tolist()) for m in maps] == every
    assert [alignment.population(m) for m in maps] == [len(s) for s in every]
    assert set(alignment.members(alignment.or_merged(maps)).tolist()) == set().union(*every)


def test_pairs_have_documents_and_links(spark):
    df = spark.createDataFrame([(0, "cat cat cat"), (1, "cat dog"), (2, None)], "doc_id long, text string")
    postings = alignment.merged_postings(alignment.index(df))
    (a,), (b,) = A.ids([" cat"])[0:1][0], B.ids(["cat"])[0]
    row = alignment.pair_counts(postings).where(f"a = {a} AND b = {b}").first()
    assert (row.n_docs, row.n_links, row.best) == (2, 4, True)


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).columns == ["doc_id", *LINE] and alignment.align(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1, 2), (None, "a b", 3, 4), (5, None, 5, 6)], "doc_id long, text string, n_a int, block int")
    got = sorted((r.doc_id is None, r.n_a, r.n_links, r.count_sum) for r in alignment.align(odd).collect())
    assert got == [(False, 0, 0, 0), (True, 2, 2, 4), (True, 2, 2, 4)]
