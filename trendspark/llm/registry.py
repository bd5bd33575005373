"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendspark.llm import (collocations, decontaminate, exact_dedup, forest_join, hard_negatives, language, licenses,
                            nearest, packing, personal, pitman_yor, quality, toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_licenses": licenses.op10_licenses,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_nearest": nearest.op12_nearest,
        "op13_collocations": collocations.op13_collocations,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_personal_data": personal.op2_personal_data,
        "op3_language": language.op3_language,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_language_model": pitman_yor.op5_language_model,
        "op6_packing": packing.op6_packing,
        "op7_jaccard_join": forest_join.op7_jaccard_join,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_quality": quality.op9_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_collocations": collocations.OP13_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
        "op7_jaccard_join": forest_join.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
    }
