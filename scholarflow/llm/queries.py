"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, filter_audit, html_extraction, near_dedup, packing, pipeline, quality_classifier, quality_rules, secrets, sharding, source_divergence, token_counts, token_output, vector_search

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_token_output": token_output.op6_token_output,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_sharding": sharding.op8_sharding,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_nearest_neighbours": vector_search.op12_nearest_neighbours,
    "op13_source_divergence": source_divergence.op13_source_divergence,
    "pipeline": pipeline.run,
}

ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_source_divergence": source_divergence.OP13_SQL,
}
