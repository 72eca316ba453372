"""The operators' queries, one op<N>_<name> each, and the pipeline."""

from __future__ import annotations

import importlib

_MODULES = (
    "op1_decontamination op2_license_scan op3_quality_classifier op4_token_output op5_chat_format op6_suffix_dedup op7_byte_bpe op8_pii op9_near_dedup op10_quality_rules "
    "op11_spelling_variants op12_conversation_repair op13_html_extraction"
).split()


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{name}"), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in _MODULES:
        sql = getattr(importlib.import_module(f"{__package__}.{name}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
