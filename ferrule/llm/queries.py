"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, license_scan, mixture, sharding, simhash, token_counts, token_packing, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_simhash": simhash.query,
        "op4_warc": warc.query,
        "op5_mixture_packing": mixture.query,
        "op6_token_packing": token_packing.query,
        "op7_histogram_sort": sharding.query,
        "op8_token_counts": token_counts.query,
        "op9_decontaminate": decontaminate.query,
        "op10_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.SQL,
        "op7_histogram_sort": sharding.SQL,
    }
