"""Registry of this subpackage: one query for each operator, and SQL where it can say the same."""

from __future__ import annotations

from quarry.llm import bpe, exactdedup, hardnegatives, jaccard, katz, langid, mixing, pii, quality, substrings, tokenfile, topk, whitening


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": langid.op2_language_id,
    "op3_katz_scoring": katz.op3_katz_scoring,
    "op4_token_files": tokenfile.op4_token_files,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii": pii.op7_pii,
    "op8_topk_search": topk.op8_topk_search,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_exact_dedup": exactdedup.op11_exact_dedup,
    "op12_hard_negatives": hardnegatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": pipeline,
}
ORACLES = {
    "op1_mixing": mixing.sql(),
    "op5_substring_dedup": substrings.SQL,
    "op8_topk_search": topk.SQL,
    "op9_quality_rules": quality.sql(),
    "op10_jaccard_join": jaccard.SQL,
    "op11_exact_dedup": exactdedup.SQL,
    "op12_hard_negatives": hardnegatives.SQL,
}
