from collections import defaultdict

import corpus_pipeline
from test_decontaminate import plain
from test_near_dedup import plain_kept
from test_packing import check_pieces, reference_ids

ENGLISH_IDS = (21, 23, 24)  # not held out
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeated_lines(docs):
    def key(line):
        cut = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in cut)

    holders = defaultdict(set)
    for doc, text in docs.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return {doc: "\n".join(line for line in text.split("\n") if gone.get(key(line), doc) == doc) for doc, text in docs.items()}


def test_stages_equal_brute_force(spark, sf):
    first = spark.read.parquet(f"{sf}/documents.parquet")
    docs, out = first, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == COLUMNS
        docs = docs.cache()
        out[name] = docs.collect()
    texts = {name: {r.doc_id: r.text for r in rows} for name, rows in out.items() if name != "packing"}
    whole = {r.doc_id: r.text for r in first.collect()}
    assert {d for d, t in whole.items() if any(c.isalpha() for c in t)} == set(texts["language_id"])
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"])
    assert texts["line_dedup"] == without_repeated_lines(texts["language_id"])
    assert set(texts["simhash_near_dedup"]) == plain_kept(texts["line_dedup"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = plain(list(texts["simhash_near_dedup"].items()), items)
    assert set(texts["decontamination"]) == {d for d, (_, n, _) in hits.items() if not n}
    kept = texts["decontamination"]
    check_pieces(out["packing"], dict(zip(kept, reference_ids(kept.values()), strict=True)))


def test_run_equals_the_stages_one_by_one(spark, sf):
    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    kept = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(pieces, dict(zip(kept, reference_ids(kept.values()), strict=True)))


def test_odd_rows_pass_all_stages(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the house of the king", None, "s", 21), (None, "the house of the king", None, "s", 21), (3, "das haus und der see", "de", None, 20), (3, "das haus und der see", "de", None, 20), (4, "!!", "en", "s", 2)]
    english = [(i, text, "en", "s", 0) for i, text in zip(ENGLISH_IDS, ("the king of the house and the sea", "the road to the house by the sea", "the king and the road"))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # Without an English text to learn from, an English one is in none of the learned languages.
    alone = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, schema), sf)
    assert {r.doc_id for r in alone.collect()} == {3}
    docs = spark.createDataFrame(rows + english, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS
    kept = docs.collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.doc_id not in ENGLISH_IDS) == [(0, "the house of the king"), (3, "das haus und der see")]
    assert {r.lang for r in kept if r.doc_id is None} == {"en"} and len(kept) == 2 + len(english)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.collect() == []
