"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from sparkgauge.llm import chat_format, conversation_repair, decontaminate, exact_dedup, heavy_hitters, lm_score, ngram_join, packing, quality, secrets, sharding, url_filter, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality": quality.op5_quality,
    "op6_pack": packing.op6_pack,
    "op7_kd_shards": sharding.op7_kd_shards,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_secrets": secrets.op10_secrets,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_warc": warc.op12_warc,
    "op13_heavy_hitters": heavy_hitters.op13_heavy_hitters,
}
ORACLES = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
}
