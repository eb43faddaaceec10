"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audio, bpe, brown, hnsw, linededup, mixing, quality, simhash, sstable, toxicity


def queries() -> dict:
    return {
        "op1_brown_class_lm": brown.op1_brown_class_lm,
        "op4_hnsw_near_dedup": hnsw.op4_hnsw_near_dedup,
        "op2_crf_toxicity": toxicity.op2_crf_toxicity,
        "op3_audio_features": audio.op3_audio_features,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op9_quality_classifier": quality.op9_quality_classifier,
        "op10_sstable_token_shards": sstable.op10_sstable_token_shards,
        "op7_mixing_target_weights": mixing.op7_mixing_target_weights,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_hnsw_near_dedup": hnsw.OP4_SQL,
        "op6_line_dedup": linededup.OP6_SQL,
        "op7_mixing_target_weights": mixing.OP7_SQL,
    }
