"""Queries and DuckDB oracles of this folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import bpe, centroids, chat, divergence, exact_dedup, htmltext, langid, minhash, mixing, nearest, packing, quality, warc

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_nearest": nearest.op2_nearest,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": langid.op6_language_id,
    "op7_main_text": htmltext.op7_main_text,
    "op8_quality": quality.op8_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_chat": chat.op10_chat,
    "op11_packing": packing.op11_packing,
    "op12_divergence": divergence.op12_divergence,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES = {
    "op1_near_duplicates": minhash.ORACLE,
    "op2_nearest": nearest.ORACLE,
    "op3_warc": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_chat": chat.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
