"""Registered queries of the corpus operators: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (chat_format, decontamination, fill_middle, language, line_dedup, mixing, nearduplicates, oracle,
                          prefix_trie, quality, secret_scan, sharding, tokens)
from tidemark.llm.common import benchmark, conversations, documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_adaptive_quality": lambda spark, d: quality.judge(documents(spark, d)),
    "op2_ppm_language": lambda spark, d: language.identify(documents(spark, d)),
    "op3_source_mix": lambda spark, d: mixing.mix(documents(spark, d)),
    "op4_packed_tokens": lambda spark, d: tokens.packed(documents(spark, d)),
    "op5_entropy_secrets": lambda spark, d: secret_scan.scan(documents(spark, d)),
    "op6_separator_scan": lambda spark, d: tokens.counted_tokens(documents(spark, d)),
    "op7_line_neighbours": lambda spark, d: line_dedup.line_report(documents(spark, d), every=True),
    "op8_positional_index": lambda spark, d: decontamination.contamination(documents(spark, d), benchmark(spark, d)),
    "op9_sampled_shards": lambda spark, d: sharding.byte_shards(documents(spark, d)),
    "op10_chosen_path": lambda spark, d: nearduplicates.duplicates(documents(spark, d)),
    "op11_prefix_trie": lambda spark, d: prefix_trie.trie(conversations(spark, d)),
    "op12_fill_middle": lambda spark, d: fill_middle.report(documents(spark, d)),
    "op13_chat_format": lambda spark, d: chat_format.report(conversations(spark, d)),
}

# Where a tokenizer, hash orders, a fitted model or too slow a search stand in the way, tests hold the
# query against brute force alone.
SQL: dict[str, str] = {
    "op1_adaptive_quality": oracle.QUALITY,
    "op5_entropy_secrets": oracle.SECRETS,
    "op8_positional_index": oracle.DECONTAMINATION,
    "op9_sampled_shards": oracle.SHARDS,
    "op10_chosen_path": oracle.NEAR_DUPLICATES,
    "op11_prefix_trie": oracle.TRIE,
    "op12_fill_middle": oracle.FILL_MIDDLE,
    "op13_chat_format": oracle.CHAT,
}
