"""The queries of this subpackage and their SQL."""

from . import ann, bloom_lm, chat_format, decontaminate, html_text, mixing, near_dedup, quality_knn, token_store, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_simhash": near_dedup.op3_simhash,
    "op4_html_text": html_text.op4_html_text,
    "op5_lm_score": bloom_lm.op5_lm_score,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality_knn.op7_quality,
    "op8_ann": ann.op8_ann,
    "op9_tokens": token_store.op9_tokens,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
