"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import language_id, media, mixing, packing, quality, rlz, secrets, simhash, suffix_dedup, url_filters

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_language_id": language_id.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_simhash": simhash.op8_simhash,
    "op9_media": media.op9_media,
    "op10_rlz_dedup": rlz.op10_rlz_dedup,
}

ORACLE_SQL = {"op1_secret_scans": secrets.OP1_SQL, "op5_quality_rules": quality.OP5_SQL, "op7_url_filters": url_filters.OP7_SQL}
