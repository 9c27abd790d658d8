"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    chat_format,
    decontaminate,
    fingerprints,
    html_extract,
    near_dedup,
    packing,
    quality_rules,
    repair,
    sharding,
    spelling,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_near_dedup,
        decontaminate.op2_decontamination,
        html_extract.op3_html_extract,
        token_counts.op4_token_counts,
        chat_format.op5_chat_format,
        sharding.op6_sharding,
        suffix_dedup.op7_suffix_dedup,
        packing.op8_packing,
        toxicity.op9_toxicity,
        quality_rules.op10_quality_rules,
        fingerprints.op11_simhash,
        spelling.op12_spelling,
        repair.op13_repair,
    )
}

ORACLE_SQL = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op6_sharding": sharding.OP6_SQL,
}
