"""The queries of this subpackage and the SQL beside them."""

from weft.llm import align, chat, clicks, decontaminate, exact, jaccard, mixing, quality, repeats, sharding, sql, tokenids, warc

QUERIES = {
    "op1_substring_dedup": repeats.op1,
    "op2_quality_rules": quality.op2,
    "op3_token_ids": tokenids.op3,
    "op4_suffix_array_dedup": repeats.op4,
    "op5_mixing": mixing.op5,
    "op6_chat_formatting": chat.op6,
    "op7_ngram_jaccard_join": jaccard.op7,
    "op8_sharding": sharding.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_warc": warc.op10,
    "op11_exact_dedup": exact.op11,
    "op12_cross_tokenizer_alignment": align.op12,
    "op13_click_windows": clicks.op13,
}
SQL = {"op1_substring_dedup": sql.OP1, "op7_ngram_jaccard_join": sql.OP7, "op10_warc": sql.OP10, "op2_quality_rules": sql.OP2, "op6_chat_formatting": sql.OP6, "op11_exact_dedup": sql.OP11, "op13_click_windows": sql.OP13}
