"""Queries of this subpackage next to their SQL twins."""

from __future__ import annotations

from holdfast.llm import align, extract, langid, minhash, mixing, phrases, ppm, quality, shuffle, tokens, topk, warc, winnow

QUERIES = {
    "op1_warc": warc.query,
    "op2_language_id": langid.query,
    "op3_html_extraction": extract.query,
    "op4_token_ids": tokens.query,
    "op5_lm_scoring": ppm.query,
    "op6_exact_topk": topk.query,
    "op7_mixing": mixing.query,
    "op8_sharding": shuffle.query,
    "op9_minhash_near_dedup": minhash.query,
    "op10_benchmark_decontamination": winnow.query,
    "op11_quality_classifier": quality.query,
    "op12_tokenizer_alignment": align.query,
    "op13_phrase_mining": phrases.query,
}
ORACLES = {
    "op6_exact_topk": topk.ORACLE_SQL,
    "op1_warc": warc.ORACLE_SQL,
    "op9_minhash_near_dedup": minhash.ORACLE_SQL,
    "op10_benchmark_decontamination": winnow.ORACLE_SQL,
    "op13_phrase_mining": phrases.ORACLE_SQL,
}
