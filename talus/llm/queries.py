"""The queries of this package and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

#: Module, query and, if SQL can express it, the name of its text.
QUERIES = [
    ("line_dedup", "op9_line_dedup", "SQL"),
    ("token_blocks", "op1_token_blocks", None),
    ("quality", "op8_quality_classifier", None),
    ("substring_dedup", "op4_substring_dedup", "SQL"),
    ("near_dedup", "op10_near_dedup", None),
    ("merkle", "op2_fingerprints", "SQL"),
    ("preferences", "op6_preference_format", "SQL"),
    ("pii", "op5_pii", None),
    ("bpe", "op7_bpe", None),
    ("decontaminate", "op3_benchmark_decontamination", "SQL"),
]


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for module, name, _ in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f".{module}", __package__), sql) for module, name, sql in QUERIES if sql}
