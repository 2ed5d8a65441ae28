"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, hmm, htmlcut, pieces_bpe, pii, quality, secrets, simhash, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_chat_rotation": chat.op4_chat_rotation,
    "op5_pii": pii.op5_pii,
    "op6_hmm_scores": hmm.op6_hmm_scores,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_sentencepiece": pieces_bpe.op8_sentencepiece,
    "op9_html_extraction": htmlcut.op9_html_extraction,
    "op10_url_filter": urlfilter.op10_url_filter,
}
SQL: dict[str, str] = {"op2_quality_rules": quality.SQL, "op3_secret_scan": secrets.SQL, "op4_chat_rotation": chat.SQL, "op10_url_filter": urlfilter.SQL}
