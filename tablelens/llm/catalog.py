"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tablelens.llm import (
    filter_audit,
    langid,
    lexical_search,
    line_dedup,
    minhash,
    mixing,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
    span_dedup,
    toxicity,
)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_sharding": sharding.op2_sharding,
    "op3_language_id": langid.op3_language_id,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_span_dedup": span_dedup.op7_span_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_minhash_fingerprints": minhash.op9_minhash_fingerprints,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE = {
    "op2_sharding": sharding.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
