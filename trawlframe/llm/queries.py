"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, language_id, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_temperature_mixing": mixing.op7_temperature_mixing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_temperature_mixing": mixing.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
