"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embeddings, html, language, lines, mixing, quality, resampling, shingles, suffixes, token_files, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mixture": mixing.op1_hierarchical_mixture,
    "op2_itq_near_duplicates": embeddings.op2_itq_near_duplicates,
    "op3_style_tree_text": html.op3_style_tree_text,
    "op4_rank_queue_bpe": bpe.op4_rank_queue_bpe,
    "op5_combination_join": shingles.op5_combination_join,
    "op6_host_rules": quality.op6_host_rules,
    "op7_prefix_doubling": suffixes.op7_prefix_doubling,
    "op8_chat_events": chat.op8_chat_events,
    "op9_repair_token_files": token_files.op9_repair_token_files,
    "op10_ftrl_language": language.op10_ftrl_language,
    "op11_concatenated_resampling": resampling.op11_concatenated_resampling,
    "op12_banded_trie": trie.op12_banded_trie,
    "op13_perfect_hash_lines": lines.op13_perfect_hash_lines,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hierarchical_mixture": mixing.oracle_sql(),
        "op6_host_rules": quality.oracle_sql(),
        "op8_chat_events": chat.oracle_sql(),
        "op11_concatenated_resampling": resampling.oracle_sql(),
        "op12_banded_trie": trie.oracle_sql(),
        "op13_perfect_hash_lines": lines.oracle_sql(),
    }
