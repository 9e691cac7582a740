"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fixity, mixing, quality, rules, secrets, simhash, suffix_tree, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": rules.query,
        "op2_toxicity": toxicity.query,
        "op3_simhash": simhash.query,
        "op4_quality": quality.query,
        "op5_suffix_tree": suffix_tree.query,
        "op6_fixity": fixity.query,
        "op7_mixing": mixing.query,
        "op8_bpe": bpe.query,
        "op9_topk": topk.query,
        "op10_secrets": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": rules.SQL, "op6_fixity": fixity.SQL, "op9_topk": topk.SQL}
