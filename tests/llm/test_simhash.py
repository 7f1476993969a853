import re

import xxhash
from tallyflow.llm.simhash import block_masks, components, fingerprint, op1_simhash, simhash_components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    fps = sorted(set(rows.values()))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc, f in rows.items():
        least[find(f)] = min(doc, least.get(find(f), doc))
    return {doc: least[find(f)] for doc, f in rows.items()}


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {doc: plain_fingerprint(text) for doc, text in docs.items()}
    expected = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()}
    assert got == {doc: (f"{fps[doc]:016x}", expected[doc]) for doc in docs}


def test_fingerprint_cases():
    assert fingerprint(None) == fingerprint(b"") == fingerprint(b" \t\n") == 0
    assert fingerprint("One two Three".encode()) == xxhash.xxh64(b"one two three", seed=42).intdigest()
    for text in ("a b c d", "a b c d e", "É x\x1cy z w v u", "a\x0bb\x0cc d e f " * 30000):
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_close_pair_shares_a_block_choice():
    masks = [m & (2**64 - 1) for m in block_masks()]
    assert len(masks) == 35
    import itertools
    import random

    for bits in itertools.chain(itertools.combinations(range(0, 64, 5), 4), (random.Random(1).sample(range(64), 4) for _ in range(500))):
        x = sum(1 << b for b in bits)
        assert any(x & m == 0 for m in masks)


def test_large_buckets_are_cut_without_losing_links(spark):
    import random

    from tallyflow.llm.simhash import links

    rng, base = random.Random(3), 0x0123456789ABCDEF
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(400)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(links(nodes, chunk=32)).collect()}
    expected = plain_components({f: f for f in fps})
    assert {f: roots.get(f, f) for f in fps} == expected


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "  ", 7), (3, "a b c d e f g", 8), (3, "a b c d e f g", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_components(df).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash_components(df.limit(0)).collect() == []
