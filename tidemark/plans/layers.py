"""Views of all layers in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import enrich, freshness, gold, ops, silver
from tidemark.sources.readers import route_policy

Views = dict[str, DataFrame]

# serving alias -> gold view
SERVING_ALIASES = {
    "mv_market_rankings": "gold_market_rankings",
    "mv_top_movers": "gold_top_movers",
    "mv_market_dominance": "gold_market_dominance",
    "mv_cross_asset_compare": "gold_cross_asset_comparison",
    "mv_enriched_rankings": "gold_enriched_rankings",
    "mv_defi_protocols": "gold_defi_protocols",
    "mv_macro_regime": "gold_macro_regime",
}


def build_layers(tables: Mapping[str, DataFrame], as_of: datetime | str) -> Views:
    """Every view as a lazy frame.

    ``tables`` holds the bronze and operations tables, and the silver tables where they have been
    written (they are built from bronze otherwise).
    """
    v: Views = dict(tables)
    policy = route_policy(next(iter(tables.values())).sparkSession)

    def gold_four() -> tuple[DataFrame, ...]:
        return (v["gold_market_rankings"], v["gold_top_movers"], v["gold_market_dominance"],
                v["gold_cross_asset_comparison"])

    steps: dict[str, Callable[[], DataFrame]] = {
        "silver_market_snapshots": lambda: silver.silver_snapshots(v["bronze_market_snapshots"]),
        "silver_market_changes": lambda: silver.silver_changes(
            silver.market_base(v["bronze_market_snapshots"])),
        "silver_market_dominance": lambda: silver.silver_dominance(v["bronze_market_snapshots"]),
        "silver_cross_asset_comparison": lambda: silver.silver_comparison(
            silver.market_base(v["bronze_market_snapshots"])),
        "silver_asset_enriched": lambda: enrich.asset_enriched(
            v["bronze_market_snapshots"], v["bronze_protocols"], v["bronze_repo_activity"], as_of),
        "silver_macro_context": lambda: enrich.macro_context(v["bronze_macro"], as_of),
        "gold_market_rankings": lambda: gold.gold_rankings(v["bronze_market_snapshots"]),
        "gold_top_movers": lambda: gold.gold_movers(
            v["silver_market_changes"], unique="silver_market_changes" not in tables),
        "gold_market_dominance": lambda: gold.gold_dominance(
            v["silver_market_dominance"], unique="silver_market_dominance" not in tables),
        "gold_cross_asset_comparison": lambda: gold.gold_comparison(
            v["silver_cross_asset_comparison"],
            unique="silver_cross_asset_comparison" not in tables),
        "gold_enriched_rankings": lambda: gold.gold_enriched(v["silver_asset_enriched"]),
        "gold_defi_protocols": lambda: gold.gold_protocols(v["silver_asset_enriched"]),
        "gold_macro_regime": lambda: gold.gold_macro_regime(v["silver_macro_context"]),
        **{alias: (lambda name=name: v[name].select("*"))
           for alias, name in SERVING_ALIASES.items()},
        "gold_freshness_status": lambda: freshness.freshness_status(
            freshness.gold_watches(*gold_four()), as_of),
        "gold_quality_status": lambda: freshness.quality_status(
            freshness.gold_quality_rules(*gold_four())),
        "gold_serving_readiness": lambda: freshness.serving_in_one_pass(
            freshness.gold_watches(*gold_four()), freshness.gold_quality_rules(*gold_four()),
            as_of),
        "ops_usage_events_normalized": lambda: ops.usage_normalized(v["ops_usage_events"]),
        "ops_route_health": lambda: ops.route_health(v["ops_usage_events_normalized"]),
        "ops_release_readiness": lambda: ops.release_readiness(
            v["ops_route_health"], policy, v["gold_serving_readiness"]),
        "ops_alert_queue": lambda: ops.alert_queue(v["ops_usage_events_normalized"]),
        "ops_bundle_runs_normalized": lambda: ops.runs_normalized(v["ops_bundle_runs"]),
        "ops_bundle_run_health": lambda: ops.run_health(v["ops_bundle_runs_normalized"]),
        "ops_bundle_run_latest": lambda: ops.run_latest(v["ops_bundle_runs_normalized"]),
        "ops_bundle_run_readiness": lambda: ops.run_readiness(
            v["ops_bundle_run_health"], v["ops_bundle_run_latest"]),
        "ops_alerts_normalized": lambda: ops.alerts_normalized(v["ops_alerts"]),
        "ops_alert_backlog_by_kind": lambda: ops.alert_backlog_by_kind(v["ops_alerts_normalized"]),
        "ops_alert_readiness": lambda: ops.alert_readiness(v["ops_alerts_normalized"]),
        "ops_ready_overview": lambda: ops.ready_overview(v["ops_release_readiness"]),
        "ops_route_readiness_latest": lambda: ops.route_latest(v["ops_release_readiness"]),
        "ops_alert_backlog": lambda: ops.alert_backlog(v["ops_alert_queue"]),
        "ops_cost_latency_trend": lambda: ops.cost_latency_trend(v["ops_release_readiness"]),
        "ops_bundle_run_status": lambda: ops.run_status(v["ops_bundle_run_readiness"]),
        "ops_alert_status": lambda: ops.alert_status(v["ops_alert_readiness"]),
    }
    for name, build in steps.items():
        if name not in v:
            v[name] = build()
    return v


def register_layers(spark: SparkSession, tables: Mapping[str, DataFrame],
                    as_of: datetime | str) -> list[str]:
    """(Re)create a temporary view for every layer object; returns the names in order."""
    views = build_layers(tables, as_of)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def serving_views(gold_views: Mapping[str, DataFrame]) -> Views:
    return {alias: gold_views[name].select("*") for alias, name in SERVING_ALIASES.items()
            if name in gold_views}
