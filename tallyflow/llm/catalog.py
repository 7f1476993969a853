"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm import alignment, decontaminate, exact_dedup, html_extract, langid, line_dedup, lm_score, neighbours, packing, prefix_trie, sharding, simhash, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_curve_packing": packing.op3_curve_packing,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_pair_bitmaps": alignment.op11_pair_bitmaps,
    "op12_learned_partitions": neighbours.op12_learned_partitions,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
