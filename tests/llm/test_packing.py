import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tallyflow.llm.packing import END_ID, LENGTH, Packer, coordinates, hilbert_keys, op3_curve_packing, pack, powers_of_two, ranges_of, token_ids
from tokenizers import Tokenizer


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(pieces, ids):
    """Every id in exactly one piece, right digests, gapless sequences, no padding."""
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        covered[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for spans, total in ((covered[d], len(own)) for d, own in ids.items()):
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= LENGTH and at.bit_count() == 1


def test_query_is_an_exact_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = dict(zip([d.doc_id for d in docs], reference_ids([d.text for d in docs]), strict=True))
    check_pieces(op3_curve_packing(spark, sf).collect(), ids)


def test_odd_texts(spark):
    texts = [None, "", "<|endoftext|>", "a<|endoftext|>b", "\x00​\U0001f9e6 é́", "word " * 20000, "x" * 30000, "  \n\n\t "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id AS id", "1 AS __tf_other")
    expected = reference_ids(texts)
    assert [token_ids(t).tolist() for t in texts] == expected
    check_pieces(pack(df).collect(), dict(enumerate(expected)))
    assert pack(df.limit(0)).collect() == []


def test_ranges_have_equal_bytes():
    rng = np.random.default_rng(3)
    cells = [(i, int(n)) for i, n in enumerate(rng.integers(1, 2000, 500))]
    cells[100] = (100, 200_000)  # a third of all bytes in one cell
    ranges, parts = ranges_of(cells, 40)
    most = sum(n for _, n in cells) / 40
    filled = np.zeros(parts)
    for (_, n), (_, part, over) in zip(cells, ranges, strict=True):
        filled[part : part + over] += n / over
    assert filled.max() <= most + 1 and parts <= 90 and (filled > 0).all()
    assert [p for _, p, _ in ranges] == sorted(p for _, p, _ in ranges)
    assert ranges_of([], 7) == ([], 0)


def test_copies_and_long_texts_are_spread(spark):
    texts = ["the same text again and again " * 20] * 300 + ["long " * 30000] + [f"text {i} " * 30 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = pack(df).collect()
    check_pieces(pieces, dict(enumerate(reference_ids(texts))))
    assert len({p.sequence_id >> 36 for p in pieces if p.doc_id < 300}) > 1


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(p.length for p in pack(df).collect()) == 3 + 3 + 2


def test_hilbert_neighbours_touch():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = hilbert_keys(side, bits=3)
    path = side[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packer_tail_and_coordinates():
    assert powers_of_two(0) == [] and powers_of_two(13) == [8, 4, 1]
    packer = Packer(0, 8)
    packer.add(1, np.arange(21, dtype="<u4"))
    packer.finish()
    assert [p[2] for p in packer.pieces] == [8, 8, 4, 1]
    assert np.isfinite(coordinates(None)).all() and np.isfinite(coordinates(b"abc" * 5)).all()
