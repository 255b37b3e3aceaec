"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, lexical, license_scan, mixing, ngram_join, packing, quality_rules, secrets, sharding, token_records, toxicity, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_sharding": sharding.op5_sharding,
    "op6_temperature_mixing": mixing.op6_temperature_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_token_records": token_records.op9_token_records,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_ranked_search": lexical.op11_ranked_search,
    "op12_conversation_repair": turns.op12_conversation_repair,
    "op13_order_minhash": fingerprints.op13_order_minhash,
    "op1_ngram_jaccard_links": ngram_join.op1_ngram_jaccard_links,
    "op3_wrapped_license_scan": license_scan.op3_wrapped_license_scan,
    "op3_full_license_texts": license_scan.op3_full_license_texts,
}

SQL = {"op11_ranked_search": lexical.SQL, "op12_conversation_repair": turns.SQL, "op2_exact_dedup": exact_dedup.SQL, "op3_license_scan": license_scan.sql(), "op3_wrapped_license_scan": license_scan.sql(wrapped=True), "op3_full_license_texts": license_scan.sql(wrapped=True, full=True)}
