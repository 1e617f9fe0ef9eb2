"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle, query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": query.op1_mixing,
    "op2_pii": query.op2_pii,
    "op3_repeats": query.op3_repeats,
    "op4_topk": query.op4_topk,
    "op6_embeddups": query.op6_embeddups,
    "op5_neardup": query.op5_neardup,
    "op7_secrets": query.op7_secrets,
    "op8_packing": query.op8_packing,
    "op9_quality": query.op9_quality,
    "op10_toxicity": query.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op4_topk": oracle.OP4, "op5_neardup": oracle.OP5, "op6_embeddups": oracle.OP6}
