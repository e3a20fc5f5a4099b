"""Registered queries of the corpus operators; their SQL is in ``oracles``."""

from __future__ import annotations

from sightline.llm import decontaminate, filter_audit, fim, jaccard, licenses, line_dedup, packing, quality, repeats, token_files, toxicity, tree_search, word_repeats
from sightline.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.query,
    "op2_nearest_neighbours": tree_search.query,
    "op3_quality_votes": quality.query,
    "op4_best_fit_packing": packing.query,
    "op5_toxicity": toxicity.query,
    "op6_token_records": token_files.query,
    "op7_license_scan": licenses.query,
    "op8_line_dedup": line_dedup.query,
    "op9_jaccard_join": jaccard.query,
    "op10_repeated_strings": repeats.query,
    "op11_fill_in_middle": fim.query,
    "op12_filter_interactions": filter_audit.query,
    "op13_repeated_words": word_repeats.query,
}
