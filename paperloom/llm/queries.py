"""The llm operators' queries, by name, and the SQL of those that SQL can express."""

from . import decontaminate, language_id, line_dedup, ngram_join, packing, sharding, token_counts, topk, toxicity, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_topk": topk.op4_topk,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": language_id.op10_language_id,
}
SQL = {
    "op3_url_filter": url_filter.SQL,
    "op4_topk": topk.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op6_sharding": sharding.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_language_id": language_id.SQL,
}
