"""Queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from murmuration.llm import bpe, chat, lexical_search, main_text, mixing, near_dup, perplexity, suffix_dedup, token_counts, topk, toxicity, vector_codes, warc

QUERIES = {
    "op1_perplexity": perplexity.op1_perplexity,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_warc": warc.op3_warc,
    "op4_chat": chat.op4_chat,
    "op5_bpe": bpe.op5_bpe,
    "op6_topk": topk.op6_topk,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_main_text": main_text.op13_main_text,
}

ORACLES = {
    "op3_warc": warc.ORACLE, "op4_chat": chat.ORACLE, "op6_topk": topk.ORACLE, "op10_mixing": mixing.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE, "op12_lexical_search": lexical_search.ORACLE,
}
