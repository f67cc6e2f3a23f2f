"""Registered queries of this folder and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from splitcraft.llm import anchors, bpe, infill, minhash, mixing, pii, quality, resampling, sharding, substrings, tokencount, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_minmax_dedup": minhash.op1_minmax_dedup,
    "op2_private_data": pii.op2_private_data,
    "op3_compression_toxicity": toxicity.op3_compression_toxicity,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_repeated_passages": substrings.op5_repeated_passages,
    "op6_jump_sharding": sharding.op6_jump_sharding,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_ball_tree_top_k": topk.op8_ball_tree_top_k,
    "op9_temperature_mixing": mixing.op9_temperature_mixing,
    "op10_bpe_round_trip": bpe.op10_bpe_round_trip,
    "op11_target_resampling": resampling.op11_target_resampling,
    "op12_block_anchor_dedup": anchors.op12_block_anchor_dedup,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_minmax_dedup": minhash.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op8_ball_tree_top_k": topk.ORACLE,
    "op12_block_anchor_dedup": anchors.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
