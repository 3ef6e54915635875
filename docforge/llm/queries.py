"""Registered queries of the package and their DuckDB oracles."""

from __future__ import annotations

from . import (byte_bpe, chat_format, embedding_dedup, exact_dedup, html_extract, importance, packing, quality, simhash,
               token_alignment, token_counts, toxicity, warc)

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_quality_discriminant": quality.op3_quality_discriminant,
    "op4_warc_dictionary": warc.op4_warc_dictionary,
    "op5_toxicity_trees": toxicity.op5_toxicity_trees,
    "op6_length_buckets": packing.op6_length_buckets,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_subspace_join": embedding_dedup.op8_subspace_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_html_tree_model": html_extract.op10_html_tree_model,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_chat_format": chat_format.op13_chat_format,
}

ORACLES = {
    "op4_warc_dictionary": warc.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_subspace_join": embedding_dedup.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_chat_format": chat_format.ORACLE,
}
