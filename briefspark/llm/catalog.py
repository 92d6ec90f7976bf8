"""The registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from briefspark.llm import bpe, bytepairs, chat, divergence, language, maxscore, mincut, packing, prefixhash, resampling, simhash, substrings, warc

QUERIES = {
    "op1_warc_merge": warc.query,
    "op2_sum_of_squares": packing.query,
    "op3_prefix_targets": chat.query,
    "op4_rank_order": language.query,
    "op5_prefix_hash": prefixhash.query,
    "op6_simhash_pivots": simhash.query,
    "op7_maxscore": maxscore.query,
    "op8_block_anchors": substrings.query,
    "op9_bpe_automaton": bpe.query,
    "op10_mincut_text": mincut.query,
    "op11_byte_pairs": bytepairs.query,
    "op12_importance_resampling": resampling.query,
    "op13_source_divergence": divergence.query,
}
ORACLE = {
    "op1_warc_merge": warc.SQL,
    "op3_prefix_targets": chat.SQL,
    "op7_maxscore": maxscore.SQL,
    "op8_block_anchors": substrings.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_source_divergence": divergence.SQL,
}
