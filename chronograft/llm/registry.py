"""Queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from chronograft.llm import q_chat, q_decontaminate, q_html, q_licenses, q_mixing, q_quality, q_secrets, q_simhash, q_substrings, q_tokens


def queries() -> dict:
    return {
        "op1_simhash": q_simhash.op1_simhash,
        "op2_decontaminate": q_decontaminate.op2_decontaminate,
        "op3_mixing": q_mixing.op3_mixing,
        "op4_suffix_dedup": q_substrings.op4_suffix_dedup,
        "op5_licenses": q_licenses.op5_licenses,
        "op6_token_output": q_tokens.op6_token_output,
        "op7_chat_format": q_chat.op7_chat_format,
        "op8_quality_rules": q_quality.op8_quality_rules,
        "op9_secrets": q_secrets.op9_secrets,
        "op10_html_text": q_html.op10_html_text,
        "quality_ablations": q_quality.quality_ablations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": q_decontaminate.SQL,
        "op3_mixing": q_mixing.SQL,
        "op4_suffix_dedup": q_substrings.SQL,
        "op5_licenses": q_licenses.SQL,
        "op7_chat_format": q_chat.SQL,
        "op8_quality_rules": q_quality.SQL,
        "quality_ablations": q_quality.ABLATIONS_SQL,
    }
