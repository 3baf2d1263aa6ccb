"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, near_dedup, packing, quality, secrets, substring_dedup, topk_search, toxicity, warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": quality.op1_pu_quality,
    "op2_birnn_toxicity": toxicity.op2_birnn_toxicity,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_fm_substring_dedup": substring_dedup.op4_fm_substring_dedup,
    "op5_warc_archive": warc_archive.op5_warc_archive,
    "op6_odd_sketch_dedup": near_dedup.op6_odd_sketch_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_bpe": bpe.op10_bpe,
}
ORACLES: dict[str, str] = {
    "op4_fm_substring_dedup": substring_dedup.ORACLE,
    "op5_warc_archive": warc_archive.ORACLE,
    "op6_odd_sketch_dedup": near_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op9_topk_search": topk_search.ORACLE,
}
