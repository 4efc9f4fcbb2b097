"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from huetide.llm.decontaminate import op2_suffix_decontamination
from huetide.llm.language import op9_string_kernel_language
from huetide.llm.licenses import op10_license_signatures
from huetide.llm.neighbours import op6_hash_prefix_forest
from huetide.llm.oracles import ORACLES
from huetide.llm.packing import op7_length_buckets
from huetide.llm.periodic import op12_periodic_runs
from huetide.llm.pseudonyms import op3_feistel_pseudonyms
from huetide.llm.repeats import op4_substring_doubling
from huetide.llm.secrets import op5_secret_scan
from huetide.llm.sharding import op13_histogram_shards
from huetide.llm.similar import op8_jaccard_components
from huetide.llm.toxicity import op1_classifier_chain_toxicity
from huetide.llm.trie import op11_conversation_trie


def secrets_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the base kinds."""
    return op5_secret_scan(spark, sf_dir).drop("spans")


def licenses_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the fixed phrases."""
    return op10_license_signatures(spark, sf_dir).drop("labels", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_classifier_chain_toxicity, op2_suffix_decontamination, op3_feistel_pseudonyms, op4_substring_doubling, op5_secret_scan, op6_hash_prefix_forest, op7_length_buckets, op8_jaccard_components, op9_string_kernel_language, op10_license_signatures, op11_conversation_trie, op12_periodic_runs, op13_histogram_shards, secrets_base_columns, licenses_base_columns)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
