"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from factloom.llm import chat, curves, exact_dedup, fill_middle, importance, lines, mixing, near_dedup, paragraphs, pieces, quality_rules, suffix_dedup, whitening


def queries():
    return {
        "op1_cube_mixing": mixing.op1_cube_mixing,
        "op2_importance_resampling": importance.op2_importance_resampling,
        "op3_paragraph_dedup": paragraphs.op3_paragraph_dedup,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
        "op11_curve_neighbours": curves.op11_curve_neighbours,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    }


def oracle_sql():
    return {
        "op5_chat_formatting": chat.OP5_SQL,
        "op6_minhash_near_dedup": near_dedup.OP6_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_suffix_array_dedup": suffix_dedup.OP10_SQL,
        "op13_fill_in_middle": fill_middle.OP13_SQL,
    }
