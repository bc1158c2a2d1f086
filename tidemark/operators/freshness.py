"""Freshness, quality and serving readiness of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import moment, pass_or_review

AsOf = datetime | str | Column


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Watch(NamedTuple):
    """A table under freshness watch."""

    df: DataFrame
    ts: str
    tier: str
    target_minutes: int


class QualityRules(NamedTuple):
    """A table under quality watch: its key and the conditions that make a row bad."""

    df: DataFrame
    keys: Sequence[str]
    not_null: Sequence[str]
    outlier: Column


def _freshness_columns(watch: Watch, now: Column) -> list[Column]:
    latest = F.col("latest_observed_at")
    age = F.timestamp_diff("MINUTE", latest, now)
    return [F.lit(watch.tier).alias("freshness_tier"),
            F.lit(watch.target_minutes).alias("freshness_target_minutes"), latest,
            now.alias("checked_at"), age.alias("freshness_age_minutes"),
            F.when(latest.isNull(), "missing")
            .when(age <= watch.target_minutes, "within_target").otherwise("stale")
            .alias("freshness_status")]


def freshness_status(watches: Mapping[str, Watch], as_of: AsOf) -> DataFrame:
    now = moment(as_of)
    return union_all([
        watch.df.agg(F.max(watch.ts).alias("latest_observed_at"))
        .select(F.lit(name).alias("asset_name"), *_freshness_columns(watch, now))
        for name, watch in watches.items()])


def _quality_totals(rule: QualityRules, ts: str | None = None) -> DataFrame:
    """One row of counts. Rows are combined per key on the map side, then the keys are summed: no
    distinct state and one scan, which also yields the latest ``ts`` if asked for. On an empty
    table the conditional sums are null."""
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule.not_null])
    extra = [] if ts is None else [F.max(ts).alias("_latest")]
    per_key = rule.df.groupBy(*rule.keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(has_null, 1).otherwise(0)).alias("_nulls"),
        F.sum(F.when(rule.outlier, 1).otherwise(0)).alias("_outliers"), *extra)
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.sum("_nulls").alias("critical_null_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key_rows"),
        F.sum("_outliers").alias("numeric_outlier_rows"),
        *([] if ts is None else [F.max("_latest").alias("latest_observed_at")]))


_QUALITY = ["row_count", "critical_null_rows", "duplicate_key_rows", "numeric_outlier_rows"]


def _quality_label() -> Column:
    return pass_or_review((F.col("critical_null_rows") == 0) & (F.col("duplicate_key_rows") == 0)
                          & (F.col("numeric_outlier_rows") == 0)).alias("quality_status")


def quality_status(rules: Mapping[str, QualityRules]) -> DataFrame:
    """Null, duplicate and outlier rows per table; an empty table is in ``review``."""
    return union_all([
        _quality_totals(rule).select(F.lit(name).alias("asset_name"), *_QUALITY, _quality_label())
        for name, rule in rules.items()])


def _serving_label() -> Column:
    serve = (F.col("freshness_status") == "within_target") & (F.col("quality_status") == "pass")
    return F.when(serve, "serve").otherwise("hold").alias("serving_status")


def serving_in_one_pass(watches: Mapping[str, Watch], rules: Mapping[str, QualityRules],
                        as_of: AsOf) -> DataFrame:
    """``serving_readiness`` of the tables watched on both sides, computing each table once."""
    now = moment(as_of)
    return union_all([
        _quality_totals(rules[name], watch.ts)
        .select(F.lit(name).alias("asset_name"), *_freshness_columns(watch, now), *_QUALITY)
        .select("*", _quality_label())
        for name, watch in watches.items() if name in rules]).select("*", _serving_label())


def serving_readiness(quality: DataFrame, freshness: DataFrame) -> DataFrame:
    return quality.join(freshness, "asset_name").select(
        "asset_name", "freshness_tier", "freshness_target_minutes", "latest_observed_at",
        "checked_at", "freshness_age_minutes", "freshness_status", *_QUALITY, "quality_status",
        _serving_label())


def gold_watches(rankings: DataFrame, movers: DataFrame, dominance: DataFrame,
                 comparison: DataFrame) -> dict[str, Watch]:
    return {
        "gold_market_rankings": Watch(rankings, "observed_at", "tier_a", 15),
        "gold_top_movers": Watch(movers, "observed_at", "tier_a", 30),
        "gold_market_dominance": Watch(dominance, "observed_at", "tier_a", 15),
        "gold_cross_asset_comparison": Watch(comparison, "observed_at", "tier_b", 60),
    }


def gold_quality_rules(rankings: DataFrame, movers: DataFrame, dominance: DataFrame,
                       comparison: DataFrame) -> dict[str, QualityRules]:
    negative = lambda *names: reduce(lambda a, b: a | b, [F.col(n) < 0 for n in names])
    wild = reduce(lambda a, b: a | b,
                  [F.abs(f"price_change_pct_{w}") > 500 for w in ("1h", "24h", "7d")])
    share = F.col("dominance_pct")
    return {
        "gold_market_rankings": QualityRules(
            rankings, ["asset_id", "observed_at"],
            ["asset_id", "observed_at", "market_cap_rank"],
            negative("market_cap_usd", "price_usd", "volume_24h_usd", "circulating_supply")),
        "gold_top_movers": QualityRules(
            movers, ["asset_id", "window_id", "observed_at"],
            ["asset_id", "observed_at", "window_id"], wild),
        "gold_market_dominance": QualityRules(
            dominance, ["observed_at", "dominance_group"], ["observed_at", "dominance_group"],
            (share < 0) | (share > 100)),
        "gold_cross_asset_comparison": QualityRules(
            comparison, ["asset_id", "observed_at", "correlation_bucket"],
            ["asset_id", "observed_at"],
            negative("price_usd", "market_cap_usd", "volume_24h_usd")),
    }


def layer_audit(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and latest time (as text) of every table."""
    return union_all([
        df.agg(F.count(F.lit(1)).alias("row_count"),
               F.max(ts).cast("string").alias("latest_observed_at"))
        .select(F.lit(name).alias("object_name"), "row_count", "latest_observed_at")
        for name, (df, ts) in tables.items()])


def source_freshness(market: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """Last ingestion and rows per source system of the market table and of whole tables."""
    measures = [F.max("ingested_at").alias("last_ingestion"),
                F.count(F.lit(1)).alias("total_records")]
    parts = [market.groupBy("source_system").agg(*measures)]
    parts += [df.agg(*measures).select(F.lit(name).alias("source_system"), "last_ingestion",
                                       "total_records") for name, df in others.items()]
    return union_all(parts)


def enrichment_health(sources: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows, last ingestion, distinct keys and mean measure per source: name -> (frame, key,
    measure). Keys are aggregated first, so no task holds a distinct set."""
    parts = []
    for name, (df, key, measure) in sources.items():
        per_key = df.groupBy(key).agg(
            F.count(F.lit(1)).alias("n"), F.max("ingested_at").alias("seen"),
            F.sum(measure).alias("total"), F.count(measure).alias("measured"))
        parts.append(per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.max("seen").alias("latest_ingest"), F.count(key).alias("unique_keys"),
            F.sum("total").cast("double").alias("total"), F.sum("measured").alias("measured"),
        ).select(F.lit(name).alias("source"), "row_count", "latest_ingest", "unique_keys",
                 F.when(F.col("measured") > 0, F.col("total") / F.col("measured"))
                 .alias("avg_measure")))
    return union_all(parts)


def ingest_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.max("observed_at").alias("latest_observed_at"),
                  F.max("ingested_at").alias("latest_ingested_at"))
