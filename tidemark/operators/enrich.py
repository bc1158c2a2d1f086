"""Enrichment layer: assets with protocol and repository data, macro context, model features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import before, dev_activity_score, moment, momentum, vol_to_cap
from tidemark.operators.latest import latest_version

AsOf = datetime | str | Column


def _latest_ingested(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """Newest row per key; rows ingested together are decided by ``ties``."""
    return latest_version(df, [key], [F.col(name).desc() for name in ("ingested_at", *ties)])


def asset_enriched(snapshots: DataFrame, protocols: DataFrame, repos: DataFrame,
                   as_of: AsOf) -> DataFrame:
    """Latest snapshot per asset with its latest protocol and repository row, keys compared
    without case. All three sides are one row per key when they meet, so no key is hot; AQE
    broadcasts a side it has measured to be small."""
    s = (_latest_ingested(snapshots, "asset_id", "source_record_id", "price_usd")
         .select("asset_id", "symbol", "name", "market_cap_rank", "price_usd", "market_cap_usd",
                 "volume_24h_usd", F.col("ingested_at").alias("snapshot_ingested_at"),
                 F.lower("asset_id").alias("_key")))
    d = (_latest_ingested(protocols, "source_record_id", "observed_at", "tvl_usd")
         .select(F.lower("source_record_id").alias("_key"), "protocol_slug",
                 F.col("category").alias("defi_category"), "tvl_usd", "fees_24h_usd",
                 "revenue_24h_usd", "mcap_tvl_ratio"))
    g = (_latest_ingested(repos, "asset_id", "observed_at", "stars", "commits_30d")
         .select(F.lower("asset_id").alias("_key"), "repo_full_name", "stars", "forks",
                 "open_issues", "contributors_count", "commits_30d", "commits_90d",
                 "repo_age_days"))
    return (s.join(d, "_key", "left").join(g, "_key", "left").drop("_key")
            .withColumn("dev_activity_score",
                        dev_activity_score("commits_30d", "stars", "contributors_count"))
            .withColumn("enriched_at", moment(as_of)))


def macro_context(observations: DataFrame, as_of: AsOf) -> DataFrame:
    """Latest value per series against the latest value at least 30 days old: one aggregate."""
    cut = F.date_sub(F.to_date(moment(as_of)), 30).cast("string")
    recency = F.struct("observation_date", "ingested_at", "source_record_id")
    row = F.struct("series_name", "observation_date", "value")
    old = F.col("observation_date") <= cut
    picked = observations.groupBy("series_id").agg(
        F.max_by(row, recency).alias("l"),
        F.max_by(F.when(old, row), F.when(old, recency)).alias("p"))
    now, then = F.col("l.value"), F.col("p.value")
    return picked.select(
        "series_id", F.col("l.series_name").alias("series_name"),
        F.col("l.observation_date").alias("latest_date"), now.alias("current_value"),
        then.alias("value_30d_ago"),
        F.when(then != 0, F.round((now - then) / F.abs(then) * 100, 4)).alias("change_30d_pct"),
        moment(as_of).alias("enriched_at"))


def market_features(changes: DataFrame, dominance: DataFrame, as_of: AsOf, days: int = 30,
                    every_btc_row: bool = False) -> DataFrame:
    """Features of the last ``days``: ratio, momentum and the BTC share of the same hour.

    The share is reduced to the latest row per hour and broadcast: 24 rows per day, however many
    assets there are, so change rows are never shuffled by hour. ``every_btc_row`` keeps all BTC
    rows, which repeats a change row once per BTC row of its hour.
    """
    start = before(as_of, days=days)
    recent = changes.filter(
        (F.col("observed_at") >= start) & F.col("asset_id").isNotNull()).select(
        "asset_id", "symbol", "observed_at", "price_change_pct_24h", "price_change_pct_7d",
        "volume_24h_usd", "market_cap_usd")
    hour = F.date_trunc("hour", "observed_at")
    btc = dominance.filter((F.col("dominance_group") == "btc")
                           & (F.col("observed_at") >= F.date_trunc("hour", start)))
    if every_btc_row:
        hourly = btc.select(hour.alias("_hour"), F.col("dominance_pct").alias("dominance_pct_btc"))
    else:
        hourly = F.broadcast(btc.groupBy(hour.alias("_hour")).agg(
            F.max_by("dominance_pct", "observed_at").alias("dominance_pct_btc")))
    joined = recent.withColumn("_hour", hour).join(hourly, "_hour", "left")
    double = lambda name: F.col(name).cast("double").alias(name)
    return joined.select(
        "asset_id", "symbol", "observed_at", double("price_change_pct_24h"),
        double("price_change_pct_7d"), double("volume_24h_usd"), double("market_cap_usd"),
        vol_to_cap("volume_24h_usd", "market_cap_usd").cast("double").alias("vol_to_cap_ratio"),
        double("dominance_pct_btc"),
        momentum("price_change_pct_24h", "price_change_pct_7d").alias("momentum_score"),
        F.to_date("observed_at").alias("feature_date"))
