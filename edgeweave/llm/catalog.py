"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import q_licenses, q_media, q_mixing, q_packing, q_quality, q_simhash, q_suffixes, q_tokenfile, q_toxicity, q_windows

QUERIES = {
    "op1_simhash": q_simhash.op1_simhash,
    "op5_quality_rules": q_quality.op5_quality_rules,
    "op6_mixing": q_mixing.op6_mixing,
    "op9_substring_dedup": q_windows.op9_substring_dedup,
    "op10_suffix_dedup": q_suffixes.op10_suffix_dedup,
    "op7_packing": q_packing.op7_packing,
    "op8_token_files": q_tokenfile.op8_token_files,
    "op3_toxicity": q_toxicity.op3_toxicity,
    "op2_media": q_media.op2_media,
    "op4_license_scan": q_licenses.op4_license_scan,
}
ORACLES = {
    "op5_quality_rules": q_quality.OP5_SQL,
    "op6_mixing": q_mixing.OP6_SQL,
    "op9_substring_dedup": q_windows.OP9_SQL,
}
