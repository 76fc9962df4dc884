"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvaspan.llm import conversation_repair, decontamination, fingerprints, language_id, lexical_search, license_scan, line_dedup, lm_scoring, mixing, preference_format, simhash_dedup, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash_dedup.op1_simhash_near_dedup,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_preference_format": preference_format.op6_preference_format,
        "op7_language_id": language_id.op7_language_id,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
        "op10_warc": warc.op10_warc,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the other operators are tested against brute force."""
    return {"op11_conversation_repair": conversation_repair.ORACLE, "op4_benchmark_decontamination": decontamination.oracle(), "op6_preference_format": preference_format.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
