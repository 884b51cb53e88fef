"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from orrery.llm import decontaminate, licences, maxent_lm, quality, sentencepiece_bpe, simhash, streaming_dedup, tokenfile, url_filter, warc

QUERIES = {
    "op1_maxent_lm": maxent_lm.op1,
    "op2_sentencepiece": sentencepiece_bpe.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_url_filter": url_filter.op4,
    "op5_simhash": simhash.op5,
    "op6_quality": quality.op6,
    "op7_licences": licences.op7,
    "op8_token_files": tokenfile.op8,
    "op9_warc": warc.op9,
    "op10_exact_dedup": streaming_dedup.op10,
}

ORACLE_SQL = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op7_licences": licences.ORACLE,
    "op10_exact_dedup": streaming_dedup.ORACLE,
}
