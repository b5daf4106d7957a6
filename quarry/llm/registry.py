"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import best_fit, classifier, exact_dedup, line_dedup, merkle, mixing, ngram_join, packing, periodic, pii, quality_rules, substring_dedup, suffix_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_pii": pii.op5_pii,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_best_fit_packing": best_fit.op13_best_fit_packing,
}
SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_mixing": mixing.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
