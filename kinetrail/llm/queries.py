"""The corpus operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, html_text, language_id, license_scan, mixing, pii, sharding, simhash, sketch, spelling, suffix_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_scaled_sketch": sketch.op3_scaled_sketch,
    "op4_text_tag_ratio": html_text.op4_text_tag_ratio,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_anchor_pii": pii.op6_anchor_pii,
    "op7_histogram_shards": sharding.op7_histogram_shards,
    "op8_systematic_mix": mixing.op8_systematic_mix,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash_vptree": simhash.op10_simhash_vptree,
    "op11_parity_bands": spelling.op11_parity_bands,
    "op12_license_templates": license_scan.op12_license_templates,
}
ORACLE_SQL = {
    "op8_systematic_mix": mixing.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_parity_bands": spelling.OP11_SQL,
}
