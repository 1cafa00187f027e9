"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, language, mixing, neighbours, pii, quality, repeats, simhash, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        bpe.op1_bpe,
        token_counts.op2_token_counts,
        neighbours.op3_neighbours,
        repeats.op4_repeats,
        language.op5_language_id,
        exact_dedup.op6_exact_dedup,
        mixing.op7_mixing,
        pii.op8_pii,
        simhash.op9_simhash,
        quality.op10_quality,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL, "op7_mixing": mixing.SQL}
