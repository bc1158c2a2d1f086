"""Serving tables: deduplicated, banded, labelled with freshness, lineage and quality.

The silver builders of this package give one row per key. ``unique=True`` says that the input
comes from them, which saves the dedup and its shuffle; tables filled in another way may repeat
keys and are deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import (direction, dominance_band, macro_regime_label, move_band,
                                        pass_or_review)
from tidemark.operators.latest import latest_version


def _served(df: DataFrame, tier: str, minutes: int, lineage: str, quality: Column) -> DataFrame:
    return (df.withColumn("freshness_tier", F.lit(tier))
            .withColumn("freshness_target_minutes", F.lit(minutes))
            .withColumn("lineage_source", F.lit(lineage))
            .withColumn("quality_status", quality))


def _not_negative(*names: str) -> Column:
    condition = F.col(names[0]) >= 0
    for name in names[1:]:
        condition = condition & (F.col(name) >= 0)
    return pass_or_review(condition)


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column], unique: bool) -> DataFrame:
    return df if unique else latest_version(df, keys, order)


def gold_rankings(bronze: DataFrame) -> DataFrame:
    rows = bronze.filter(F.col("asset_id").isNotNull() & F.col("observed_at").isNotNull()
                         & F.col("market_cap_rank").isNotNull())
    best = latest_version(
        rows.withColumn("observed_at", F.col("observed_at").cast("timestamp")),
        ["asset_id", "observed_at"],
        [F.col("market_cap_rank").asc(), F.col("volume_24h_usd").desc(), F.col("symbol").asc(),
         F.col("source_record_id").desc()])
    columns = best.select(
        "asset_id", "symbol", F.coalesce("name", F.lit("unmapped")).alias("name"),
        F.coalesce("category", F.lit("unclassified")).alias("category"), "observed_at",
        "market_cap_usd", "price_usd", "volume_24h_usd", "circulating_supply", "market_cap_rank")
    return _served(columns, "tier_a", 15, "bronze_market_snapshots", _not_negative(
        "market_cap_usd", "price_usd", "volume_24h_usd", "circulating_supply"))


def gold_movers(changes: DataFrame, unique: bool = False) -> DataFrame:
    rows = changes.filter(F.col("asset_id").isNotNull() & F.col("window_id").isNotNull()
                          & F.col("observed_at").isNotNull())
    best = _one_per_key(rows, ["asset_id", "window_id", "observed_at"],
                        [F.abs("price_change_pct_24h").desc(), F.col("volume_24h_usd").desc(),
                         F.col("symbol").asc()], unique)
    columns = best.select(
        "asset_id", "symbol", F.coalesce("name", F.lit("unmapped")).alias("name"), "observed_at",
        "window_id", "price_change_pct_1h", "price_change_pct_24h", "price_change_pct_7d",
        "volume_24h_usd", "market_cap_usd",
        direction("price_change_pct_24h").alias("move_direction_24h"),
        move_band("price_change_pct_24h").alias("move_band_24h"))
    in_range = [F.abs(f"price_change_pct_{w}") <= 500 for w in ("1h", "24h", "7d")]
    return _served(columns, "tier_a", 30, "silver_market_changes",
                   pass_or_review(in_range[0] & in_range[1] & in_range[2]))


def gold_dominance(dominance: DataFrame, unique: bool = False) -> DataFrame:
    rows = dominance.filter(F.col("observed_at").isNotNull() & F.col("dominance_group").isNotNull())
    best = _one_per_key(rows, ["observed_at", "dominance_group"],
                        [F.col("dominance_pct").desc(), F.col("market_cap_usd").desc()], unique)
    columns = best.select("observed_at", "dominance_group", "market_cap_usd", "dominance_pct",
                          dominance_band("dominance_pct").alias("dominance_band"))
    return _served(columns, "tier_a", 15, "silver_market_dominance",
                   pass_or_review(F.col("dominance_pct").between(0, 100)))


def gold_comparison(comparison: DataFrame, unique: bool = False) -> DataFrame:
    rows = (comparison.filter(F.col("asset_id").isNotNull() & F.col("observed_at").isNotNull())
            .withColumn("correlation_bucket", F.coalesce("correlation_bucket", F.lit("general"))))
    best = _one_per_key(rows, ["asset_id", "observed_at", "correlation_bucket"],
                        [F.col("volume_24h_usd").desc(), F.col("price_usd").desc(),
                         F.col("symbol").asc()], unique)
    columns = best.select(
        "asset_id", "symbol", "observed_at", "price_usd", "market_cap_usd", "volume_24h_usd",
        "price_change_pct_24h", "price_change_pct_7d", "correlation_bucket",
        direction("price_change_pct_24h").alias("price_change_direction_24h"))
    return _served(columns, "tier_b", 60, "silver_cross_asset_comparison",
                   _not_negative("price_usd", "market_cap_usd", "volume_24h_usd"))


def gold_enriched(enriched: DataFrame) -> DataFrame:
    columns = enriched.select(
        "asset_id", "symbol", "name", "market_cap_rank", "price_usd", "market_cap_usd",
        "volume_24h_usd", "defi_category", "tvl_usd", "fees_24h_usd", "revenue_24h_usd",
        "mcap_tvl_ratio", "repo_full_name", "stars", "commits_30d", "contributors_count",
        "dev_activity_score", "enriched_at")
    return _served(columns, "tier_b", 360, "silver_asset_enriched",
                   pass_or_review(F.col("asset_id").isNotNull()))


def gold_protocols(enriched: DataFrame) -> DataFrame:
    columns = enriched.filter(F.col("tvl_usd") > 0).select(
        "asset_id", "symbol", "name", "protocol_slug", "defi_category", "tvl_usd",
        "fees_24h_usd", "revenue_24h_usd", "mcap_tvl_ratio", "enriched_at")
    return _served(columns, "tier_b", 360, "silver_asset_enriched", F.lit("pass"))


def gold_macro_regime(macro: DataFrame) -> DataFrame:
    columns = macro.select(
        "series_id", "series_name", "latest_date", "current_value", "value_30d_ago",
        "change_30d_pct",
        macro_regime_label("series_id", "current_value", "change_30d_pct").alias("regime_label"),
        "enriched_at")
    return _served(columns, "tier_c", 1440, "silver_macro_context", F.lit("pass"))
