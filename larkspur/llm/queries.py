"""The queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import audit, chat, decontaminate, lines, lm, mixing, near, periodic, pii, quality, repeats, tokens, topk
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": lambda s, d: repeats.op1_suffix_dedup(table(s, d, "documents")),
        "op2_chat_formatting": lambda s, d: chat.op2_chat(table(s, d, "conversations")),
        "op3_line_dedup": lambda s, d: lines.op3_line_dedup(table(s, d, "documents")),
        "op4_lm_scoring": lambda s, d: lm.op4_lm_scoring(table(s, d, "documents")),
        "op5_minhash_near_dedup": lambda s, d: near.op5_near_dedup(table(s, d, "documents")),
        "op6_quality_rules": lambda s, d: quality.op6_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op7_contextual_pii": lambda s, d: pii.op7_pii(table(s, d, "documents")),
        "op8_token_counts": lambda s, d: tokens.op8_token_counts(table(s, d, "documents")),
        "op9_source_mixing": lambda s, d: mixing.op9_mixing(table(s, d, "documents")),
        "op10_decontamination": lambda s, d: decontaminate.op10_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op11_filter_audit": lambda s, d: audit.op11_filter_audit(table(s, d, "documents"), table(s, d, "labels")),
        "op12_exact_top_k": lambda s, d: topk.op12_top_k(table(s, d, "embeddings")),
        "op13_periodic_runs": lambda s, d: periodic.op13_periodic_runs(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.OP2_SQL, "op3_line_dedup": lines.OP3_SQL, "op5_minhash_near_dedup": near.OP5_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_exact_top_k": topk.OP12_SQL}
