"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, delta_lloyd, exact_dedup, html_text, katz, langid, media, near_dedup, packing, sentencepiece_scan, sharding, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_scan.op1_sentencepiece,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_media": media.op3_media,
    "op4_langid": langid.op4_langid,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sharding": sharding.op6_sharding,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_packing": packing.op8_packing,
    "op9_html": html_text.op9_html,
    "op10_katz": katz.op10_katz,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_clustering": delta_lloyd.op12_clustering,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_sharding": sharding.op6_sql(),
    "op11_decontamination": decontaminate.OP11_SQL,
    "op12_clustering": delta_lloyd.op12_sql(),
}
