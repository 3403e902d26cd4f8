"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module, query, name of its SQL (None: SQL cannot express it; tests/llm hold a brute-force version)
_QUERIES = [
    ("decontam", "op1_bm25_decontamination", None),
    ("quality", "op2_quality_classifier", None),
    ("repeats", "op3_substring_dedup", None),
    ("pii", "op4_feistel_pii", None),
    ("exact_dedup", "op5_exact_dedup", "OP5_SQL"),
    ("mixing", "op6_entropy_mixing", None),
    ("repeats", "op7_suffix_array_dedup", None),
    ("chat", "op8_chat_formatting", "OP8_SQL"),
    ("langid", "op9_hyperdimensional_langid", None),
    ("near_dedup", "op10_minhash_near_dedup", None),
    ("clustering", "op11_centroid_clustering", "OP11_SQL"),
    ("negatives", "op12_hard_negative_mining", "OP12_SQL"),
    ("packing", "op13_best_fit_packing", None),
]


def queries() -> dict:
    return {q: getattr(import_module(f"{__package__}.{m}"), q) for m, q, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(import_module(f"{__package__}.{m}"), s) for m, q, s in _QUERIES if s}
