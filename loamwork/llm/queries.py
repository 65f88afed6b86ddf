"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, html_content, imatch, mixing, quality, simhash, suffix_dedup, token_files, tool_calls, toxicity


def queries() -> dict:
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_token_files": token_files.op3_token_files,
        "op4_tool_calls": tool_calls.op4_tool_calls,
        "op4_all_tool_calls": tool_calls.op4_all_tool_calls,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_html_content": html_content.op6_html_content,
        "op7_simhash": simhash.op7_simhash,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_imatch": imatch.op9_imatch,
        "op10_quality_rules": quality.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing.OP1_SQL, "op4_tool_calls": tool_calls.OP4_SQL}
