"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, html_text, matroska, merkle, ngram_join, packing, quality, spelling, suffixes, token_count, url_rules, vectors, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_vectors": vectors.op4_near_vectors,
    "op5_media": matroska.op5_media,
    "op6_packing": packing.op6_packing,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_token_counts": token_count.op8_token_counts,
    "op9_jaccard": ngram_join.op9_jaccard,
    "op10_warc": warc.op10_warc,
    "op11_merkle": merkle.op11_merkle,
    "op12_url_rules": url_rules.op12_url_rules,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op10_warc": warc.ORACLE_OP10,
    "op11_merkle": merkle.ORACLE_OP11,
    "op12_url_rules": url_rules.ORACLE_OP12,
    "op13_spelling": spelling.ORACLE_OP13,
}
