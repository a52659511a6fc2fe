"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat_format, embedding_dedup, exact_dedup, langid, lexical_search, license_scan, mixing, ngram_join, repeat_removal, sentencepiece_sampling, url_filter, vector_codes, warc

QUERIES: dict = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_sentencepiece": sentencepiece_sampling.op5_sentencepiece,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_repeat_removal": repeat_removal.op10_repeat_removal,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLES: dict = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_license_scan": license_scan.OP13_SQL,
}
