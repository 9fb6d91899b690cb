"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import fingerprints, licenses, main_text, mixing, packing, personal, quality, repair, repeats, simhash, token_counts, urls, whitening

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_token_counts": token_counts.query,
    "op3_packing": packing.query,
    "op4_fingerprints": fingerprints.query,
    "op5_simhash": simhash.query,
    "op6_personal_data": personal.query,
    "op7_url_filter": urls.query,
    "op8_quality_rules": quality.query,
    "op9_license_scan": licenses.query,
    "op10_main_text": main_text.query,
    "op11_whitening": whitening.query,
    "op12_substring_dedup": repeats.query,
    "op13_repair": repair.query,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op8_quality_rules": quality.ORACLE,
}
