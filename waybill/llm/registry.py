"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from waybill.llm import chat_format, jaccard_join, merkle, mixing, nn_descent, pieces, secret_scan, sharding, token_alignment, token_counts, toxicity, url_filter, wand_search

QUERIES = {
    "op1_chat_snapshots": chat_format.query,
    "op2_source_mixing": mixing.query,
    "op3_merkle": merkle.query,
    "op4_toxicity": toxicity.query,
    "op5_secret_scan": secret_scan.query,
    "op6_token_lengths": token_counts.query,
    "op7_url_rules": url_filter.query,
    "op8_nn_descent": nn_descent.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_sentencepiece": pieces.query,
    "op11_interleaved_shards": sharding.query,
    "op12_token_alignment": token_alignment.query,
    "op13_wand_search": wand_search.query,
}
SQL = {
    "op1_chat_snapshots": chat_format.SQL,
    "op2_source_mixing": mixing.SQL,
    "op3_merkle": merkle.SQL,
    "op7_url_rules": url_filter.SQL,
    "op8_nn_descent": nn_descent.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_interleaved_shards": sharding.SQL,
    "op13_wand_search": wand_search.SQL,
}
