"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import align, bpe, centroids, decontam, html, jaccard, packing, passages, quality, tokenfile, toxicity, urlfilter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_ids": tokenfile.op6_token_ids,
    "op7_bpe": bpe.op7_bpe,
    "op8_substring_dedup": passages.op8_substring_dedup,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_url_filters": urlfilter.op10_url_filters,
    "op11_centroids": centroids.op11_centroids,
    "op12_packing": packing.op12_packing,
    "op13_alignment": align.op13_alignment,
}
ORACLE_SQL = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_quality_rules": quality.ORACLE_SQL,
    "op4_decontamination": decontam.ORACLE_SQL,
    "op9_ngram_jaccard": jaccard.ORACLE_SQL,
    "op10_url_filters": urlfilter.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
}
