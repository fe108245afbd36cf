"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from shelfmark.llm import decontamination, langid, packing, quality, sharding, simhash, suffix_dedup, token_counts, toxicity, url_lists

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_simhash": simhash.query,
    "op3_quality": quality.query,
    "op4_decontamination": decontamination.query,
    "op5_token_counts": token_counts.query,
    "op6_sharding": sharding.query,
    "op7_url_lists": url_lists.query,
    "op8_packing": packing.query,
    "op9_toxicity": toxicity.query,
    "op10_language": langid.query,
}

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": suffix_dedup.SQL, "op3_quality": quality.oracle_sql(), "op7_url_lists": url_lists.SQL}
