"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontam, factors, html_main, jaccard, licenses, negatives, quality, runs, substring, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_html_extraction": html_main.op5_html_extraction,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_first_copies": factors.op12_first_copies,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op2_exact_topk": topk.SQL,
    "op3_ngram_jaccard_join": jaccard.SQL,
    "op4_substring_dedup": substring.SQL,
    "op6_chat_formatting": chat.SQL,
    "op12_first_copies": factors.SQL,
    "op13_hard_negatives": negatives.SQL,
}
