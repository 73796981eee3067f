"""Queries of this subpackage and their SQL, by the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, lsm_dedup, neardup, ogg, packing, secrets_scan, substring, toxicity, url_lm, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": substring.op1_substring,
        "op2_ogg": ogg.op2_ogg,
        "op3_secrets": secrets_scan.op3_secrets,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_url_filter": url_lm.op5_url_filter,
        "op6_warc": warc.op6_warc,
        "op7_packing": packing.op7_packing,
        "op8_minhash": neardup.op8_minhash,
        "op9_bpe": bpe.op9_bpe,
        "op10_exact_dedup": lsm_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.SQL, "op10_exact_dedup": lsm_dedup.SQL}
