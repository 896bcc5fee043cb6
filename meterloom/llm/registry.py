"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from meterloom.llm import decontam, exact_dedup, langid, lm_scoring, merkle, minmax, mixing, quality, secret_scan, simhash, spelling, token_counts, warc

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_warc_index": warc.op4_warc_index,
    "op5_quality_resampling": quality.op5_quality_resampling,
    "op6_language_id": langid.op6_language_id,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_minmax_near_dedup": minmax.op11_minmax_near_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_minmax_near_dedup": minmax.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
