"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from lectern.llm import decontaminate, exact_dedup, filter_audit, jaccard_join, language_id, line_dedup, pieces, pii, pipeline, quality_classifier, quality_rules, spelling, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_benchmark_decontamination": decontaminate.query,
        "op3_language_id": language_id.query,
        "op4_jaccard_join": jaccard_join.query,
        "op5_pieces": pieces.query,
        "op6_quality_classifier": quality_classifier.query,
        "op7_line_dedup": line_dedup.query,
        "op8_pii": pii.query,
        "op9_quality_rules": quality_rules.query,
        "op10_toxicity": toxicity.query,
        "op11_spelling_variants": spelling.query,
        "op12_exact_dedup": exact_dedup.query,
        "op13_filter_audit": filter_audit.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc": warc.SQL,
        "op2_benchmark_decontamination": decontaminate.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op11_spelling_variants": spelling.SQL,
        "op12_exact_dedup": exact_dedup.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
