"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from urlsieve.llm import alignment, chat, linededup, media, mixing, pieces, quality, repeats, simhash, structure, tokencount, tokenids, urlfilter

QUERIES = {
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_cross_tokenizer": alignment.op11_cross_tokenizer,
    "op12_conversation_repair": structure.op12_conversation_repair,
    "op13_suffix_dedup": repeats.op13_suffix_dedup,
    "op1_token_ids": tokenids.op1_token_ids,
    "op2_url_filters": urlfilter.op2_url_filters,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_simhash": simhash.op5_simhash,
    "op6_chat_format": chat.op6_chat_format,
    "op7_media": media.op7_media,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": linededup.op9_line_dedup,
}

SQL = {
    "op12_conversation_repair": structure.SQL,
    "op13_suffix_dedup": repeats.SQL,
    "op2_url_filters": urlfilter.SQL,
    "op4_quality_rules": quality.SQL,
    "op8_mixing": mixing.SQL,
    "op9_line_dedup": linededup.SQL,
}
