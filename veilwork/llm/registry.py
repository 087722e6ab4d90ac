"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import chat, covertree, html, mixing, piece, quality, simhash, tokencount, toxicity, vafile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_covertree": covertree.op2_covertree,
        "op3_topk": vafile.op3_topk,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_mixing": mixing.op5_mixing,
        "op6_sentencepiece": piece.op6_sentencepiece,
        "op7_quality": quality.op7_quality,
        "op8_chat": chat.op8_chat,
        "op9_html": html.op9_html,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_covertree": covertree.OP2_SQL, "op3_topk": vafile.OP3_SQL, "op8_chat": chat.OP8_SQL}
