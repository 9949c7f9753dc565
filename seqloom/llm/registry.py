"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from seqloom.llm import conversation_repair, decontaminate, flac, html_text, lm_score, mixing, near_dedup, quality_crf, secrets, token_shards, toxicity, url_filter


def queries() -> dict:
    return {
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_quality_crf": quality_crf.op11_quality_crf,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op1_token_shards": token_shards.op1_token_shards,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
        "op6_html_extraction": html_text.op6_html_extraction,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_flac_media": flac.op8_flac_media,
        "op9_url_filter": url_filter.op9_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op12_conversation_repair": conversation_repair.OP12_SQL,
        "op3_mix_sources": mixing.OP3_SQL,
        "op4_benchmark_decontamination": decontaminate.OP4_SQL,
        "op5_minhash_near_dedup": near_dedup.OP5_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
    }
