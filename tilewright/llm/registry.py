"""The corpus queries and their DuckDB twins."""

from __future__ import annotations

from . import context_tree, exact_dedup, jaccard, line_dedup, mixing, negatives, packing, quality, suffix_dedup, toxicity, warc, whitening, wrappers

QUERIES = {
    "op1_context_tree": context_tree.op1_context_tree,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pack_best_fit": packing.op3_pack_best_fit,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_toxicity_fm": toxicity.op7_toxicity_fm,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_main_text": wrappers.op13_main_text,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op9_warc_revisits": warc.ORACLE,
    "op10_ngram_jaccard": jaccard.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
