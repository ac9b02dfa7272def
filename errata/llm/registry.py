"""Queries of the numbered operators and their oracle SQL."""

from __future__ import annotations

from errata.llm import ann, collocation, embed_dedup, fim, html_extract, line_dedup, mixing, packing, quality, sharding, simhash, suffix_dedup, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_warc_index_merge": warc.op2_warc_index_merge,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_shard_table": sharding.op4_shard_table,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_learned_partitions": ann.op6_learned_partitions,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_mix_to_targets": mixing.op8_mix_to_targets,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_html_extraction": html_extract.op10_html_extraction,
    "op11_phrase_collocation": collocation.op11_phrase_collocation,
    "op12_embedding_near_dedup": embed_dedup.op12_embedding_near_dedup,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op2_warc_index_merge": warc.ORACLE_SQL,
    "op4_shard_table": sharding.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op11_phrase_collocation": collocation.ORACLE_SQL,
    "op12_embedding_near_dedup": embed_dedup.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
