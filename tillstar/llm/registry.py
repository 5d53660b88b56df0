"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chaining, chat, decontam, jaccard, langid, licenses, negatives, phrases, quality, segment, sharding, suffix_dedup, urls

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1,
    "op2_chat_format": chat.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_jump_sharding": sharding.op4,
    "op5_language_id": langid.op5,
    "op6_quality_votes": quality.op6,
    "op7_piece_samples": segment.op7,
    "op8_chained_passages": chaining.op8,
    "op9_decontaminate": decontam.op9,
    "op10_license_scan": licenses.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_phrase_collocations": phrases.op12,
    "op13_url_reputation": urls.op13,
}
ORACLE = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op9_decontaminate": decontam.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
    "op13_url_reputation": urls.OP13_SQL,
}
