"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import frequency, language, leakage, normalize, overlap, packing, pii, sentences, subjects


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": sentences.p1_found,
        "p1_sentences": sentences.p1_sentences,
        "p2_found": normalize.p2_found,
        "p2_token_forms": normalize.p2_token_forms,
        "p2_request_forms": normalize.p2_request_forms,
        "p3_found": language.p3_found,
        "p3_records": language.p3_records,
        "p4_found": pii.p4_found,
        "p4_masked": pii.p4_masked,
        "p5_found": frequency.p5_found,
        "p5_frequencies": frequency.p5_frequencies,
        "p6_found": overlap.p6_found,
        "p6_report": overlap.p6_report,
        "p7_pack": packing.p7_pack,
        "p7_summary": packing.p7_summary,
        "p8_found": leakage.p8_found,
        "p8_report": leakage.p8_report,
        "p9_found": subjects.p9_found,
        "p9_composition": subjects.p9_composition,
    }


def oracle_sql() -> dict[str, str]:
    return {**frequency.SQL}
