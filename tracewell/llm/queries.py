"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bpe, divergence, interactions, lines, media, minhash, mixing, neighbours, quality, substrings, token_files, toxicity, urls

QUERIES = {
    "op4_line_dedup": lines.query,
    "op2_substring_dedup": substrings.query,
    "op3_toxicity": toxicity.query,
    "op5_url_filters": urls.query,
    "op7_minhash": minhash.query,
    "op8_mixing": mixing.query,
    "op1_bpe": bpe.query,
    "op6_token_files": token_files.query,
    "op9_quality_rules": quality.query,
    "op10_media_columns": media.query,
    "op11_hash_forest": neighbours.query,
    "op12_filter_audit": interactions.query,
    "op13_source_divergence": divergence.query,
}
ORACLES = {
    "op4_line_dedup": lines.SQL,
    "op7_minhash": minhash.SQL,
    "op2_substring_dedup": substrings.SQL,
    "op8_mixing": mixing.SQL,
    "op9_quality_rules": quality.SQL,
    "op12_filter_audit": interactions.SQL,
    "op13_source_divergence": divergence.SQL,
}
