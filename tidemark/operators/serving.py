"""Serving queries: filter, order with tie-breakers, limit. Sort and limit become one
TakeOrderedAndProject, so only the top rows of each task travel."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import before, severity
from tidemark.operators.ops import count_where
from tidemark.operators.validate import filter_assets

AsOf = datetime | str | Column


def _passing(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quality_status") == "pass")


def top(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first rows in order; all rows where there is no limit."""
    return df.orderBy(*order) if limit is None else df.orderBy(*order).limit(limit)


def top_at_latest(df: DataFrame, ts: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows among those at the latest ``ts``, in one pass.

    The newest rows sort first, so the top rows hold all candidates; those of an older time are
    dropped afterwards by a window over at most ``limit`` rows.
    """
    head = top(df, [F.col(ts).desc(), *order], limit)
    newest = F.max(ts).over(Window.partitionBy(F.lit(0)))
    return head.withColumn("_newest", newest).filter(F.col(ts) == F.col("_newest")).drop("_newest")


def at_latest(df: DataFrame, ts: str) -> DataFrame:
    """All rows at the latest ``ts`` (the broadcast side is one row)."""
    newest = df.agg(F.max(ts).alias(ts))
    return df.join(F.broadcast(newest), ts, "left_semi")


def top_rankings(rankings: DataFrame, limit: int = 100) -> DataFrame:
    rows = _passing(rankings).select(
        "asset_id", "symbol", "name", "category", "observed_at", "market_cap_usd", "price_usd",
        "volume_24h_usd", "circulating_supply", "market_cap_rank", "freshness_tier",
        "quality_status")
    return top(rows, ranking_order(), limit)


def ranking_order() -> list[Column]:
    return [F.col("market_cap_rank").asc(), F.col("observed_at").desc(), F.col("asset_id").asc()]


def app_rankings(rankings: DataFrame, limit: int = 12) -> DataFrame:
    """Dashboard form: any quality, with an empty change column."""
    rows = rankings.select("asset_id", "symbol", "name", "price_usd",
                           F.lit(None).cast("double").alias("price_change_pct_24h"),
                           "market_cap_usd", "volume_24h_usd", "market_cap_rank", "observed_at")
    return top(rows, ranking_order(), limit)


def mover_order() -> list[Column]:
    return [F.abs("price_change_pct_24h").desc_nulls_last(), F.col("asset_id").asc()]


def latest_movers(movers: DataFrame, limit: int = 10) -> DataFrame:
    rows = _passing(movers).select(
        "asset_id", "symbol", "name", "observed_at", "window_id", "price_change_pct_1h",
        "price_change_pct_24h", "price_change_pct_7d", "volume_24h_usd", "market_cap_usd",
        "move_direction_24h", "move_band_24h", "quality_status")
    return top_at_latest(rows, "observed_at", mover_order(), limit)


def movers_or_fallback(movers: DataFrame, comparison: DataFrame, limit: int = 10) -> DataFrame:
    """Largest moves; where there are no movers at all, the comparison table answers."""
    columns = ["asset_id", "symbol", "name", "price_change_pct_24h", "price_change_pct_7d",
               "volume_24h_usd", "market_cap_usd"]
    order = [*mover_order(), F.col("volume_24h_usd").desc(), F.col("market_cap_usd").desc()]
    first = top(movers.select(*columns), order, limit)
    empty = movers.limit(1).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 0)
    second = top(comparison.withColumn("name", F.col("asset_id")).select(*columns), order, limit)
    return first.unionByName(second.crossJoin(F.broadcast(empty)).drop("_n"))


def latest_dominance(dominance: DataFrame) -> DataFrame:
    rows = _passing(dominance).select("observed_at", "dominance_group", "market_cap_usd",
                                      "dominance_pct", "dominance_band", "quality_status")
    return at_latest(rows, "observed_at").orderBy(F.desc("dominance_pct"), "dominance_group")


def latest_comparison(comparison: DataFrame, asset_ids: Sequence[str] | None = None,
                      limit: int = 50) -> DataFrame:
    """Rows at the latest passing time, then the asset list: assets without a row at that time
    do not move the time back."""
    rows = _passing(comparison).select(
        "asset_id", "symbol", "observed_at", "price_usd", "market_cap_usd", "volume_24h_usd",
        "price_change_pct_24h", "price_change_pct_7d", "correlation_bucket", "quality_status")
    order = [F.col("market_cap_usd").desc(), F.col("asset_id").asc()]
    if not asset_ids:
        return top_at_latest(rows, "observed_at", order, limit)
    return top(filter_assets(at_latest(rows, "observed_at"), asset_ids), order, limit)


def overview_datasets(gold: dict[str, DataFrame],
                      asset_ids: Sequence[str] | None = None) -> dict[str, DataFrame]:
    return {"rankings": top_rankings(gold["rankings"]), "movers": latest_movers(gold["movers"]),
            "dominance": latest_dominance(gold["dominance"]),
            "comparisons": latest_comparison(gold["comparison"], asset_ids)}


def top_protocols(protocols: DataFrame, limit: int = 10) -> DataFrame:
    rows = _passing(protocols).select(
        "protocol_slug", F.col("name").alias("protocol_name"), "tvl_usd", "fees_24h_usd",
        "revenue_24h_usd", "mcap_tvl_ratio", "enriched_at")
    return top(rows, [F.col("tvl_usd").desc_nulls_last(), F.col("protocol_slug").asc(),
                      F.col("protocol_name").asc()], limit)


def macro_latest(macro: DataFrame, limit: int | None = 8) -> DataFrame:
    rows = _passing(macro).select(
        "series_name", F.col("latest_date").alias("observation_date"),
        F.col("current_value").alias("value"), "regime_label", "change_30d_pct")
    return top(rows, [F.col("observation_date").desc(), F.col("series_name").asc()], limit)


def watermark(df: DataFrame, ts: str = "observed_at") -> DataFrame:
    return df.agg(F.max(ts).alias("watermark"))


def top_activity(enriched: DataFrame, limit: int = 20) -> DataFrame:
    rows = enriched.select("asset_id", "dev_activity_score", "commits_30d", "stars",
                           "contributors_count")
    return top(rows, [F.col("dev_activity_score").desc_nulls_last(), F.col("asset_id").asc()], limit)


def recent(df: DataFrame, ts: str, cols: Sequence[str], limit: int,
           tie: Sequence[str] = ()) -> DataFrame:
    return top(df, [F.col(ts).desc(), *[F.col(name).asc() for name in tie]], limit).select(*cols)


RECENT_USAGE = ["event_time", "tenant_id", "user_id", "route_selected", "model_or_engine",
                "model_tier", "total_tokens", "latency_ms", "cost_estimate", "response_status"]
AUDIT_TRAIL = ["event_time", "request_id", "tenant_id", "user_id", "route_selected",
               "model_or_engine", "model_tier", "total_tokens", "latency_ms", "cost_estimate",
               "response_status", "freshness_watermark"]
RECENT_RUNS = ["ingested_at", "job_name", "status", "run_id", "rows_written", "error_message"]


def recent_usage(usage: DataFrame, limit: int = 200) -> DataFrame:
    return recent(usage, "event_time", RECENT_USAGE, limit, ["request_id"])


def audit_trail(usage: DataFrame, limit: int = 100) -> DataFrame:
    return recent(usage, "event_time", AUDIT_TRAIL, limit, ["request_id"])


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return recent(runs, "ingested_at", RECENT_RUNS, limit, ["job_name", "run_id"])


def cost_by_tier(usage: DataFrame, as_of: AsOf | None = None,
                 hours: float | None = None) -> DataFrame:
    rows = usage if hours is None else usage.filter(
        F.col("event_time") >= before(as_of, hours=hours))
    return (rows.groupBy("model_tier")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("total_tokens"),
                 F.sum("cost_estimate").alias("total_cost_usd"),
                 F.avg("latency_ms").alias("avg_latency_ms"),
                 F.max("event_time").alias("latest_request"))
            .orderBy(F.desc_nulls_last("total_cost_usd"), "model_tier"))


def daily_spend(usage: DataFrame, as_of: AsOf, days: int = 14) -> DataFrame:
    return (usage.filter(F.col("event_time") >= before(as_of, days=days))
            .groupBy(F.to_date("event_time").alias("day"), "model_tier")
            .agg(F.sum("cost_estimate").alias("cost_usd"), F.sum("total_tokens").alias("tokens"))
            .orderBy("day", "model_tier"))


def cost_by_tenant(usage: DataFrame, limit: int = 20) -> DataFrame:
    costs = usage.groupBy("tenant_id", "model_tier").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("cost_estimate").alias("total_cost_usd"),
        F.sum("total_tokens").alias("total_tokens"))
    return top(costs, [F.desc_nulls_last("total_cost_usd"), F.asc("tenant_id"),
                       F.asc("model_tier")], limit)


def recent_trend(trend: DataFrame, as_of: AsOf, hours: float = 72) -> DataFrame:
    return (trend.filter(F.col("hour_bucket") >= before(as_of, hours=hours))
            .orderBy(F.desc("hour_bucket"), "route_selected"))


def readiness_surfaces(overview: DataFrame, routes: DataFrame, backlog: DataFrame,
                       runs: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    """The five ordered surfaces of the readiness page."""
    return {
        "overview": overview,
        "routes": routes.orderBy("route_selected"),
        "backlog": backlog.orderBy(F.desc("alert_count"), F.desc("latest_event_time")),
        "runs": runs.orderBy(F.desc("latest_update_time"), "job_name"),
        "alerts": alerts}


def alerts_with_severity(alerts: DataFrame, limit: int = 100) -> DataFrame:
    rows = alerts.select(F.col("created_at").alias("alert_time"), "kind",
                         severity("kind").alias("severity"), "route_selected", "message",
                         "tenant_id", "request_id")
    return top(rows, [F.desc("alert_time"), F.asc("kind"), F.asc("request_id")], limit)


def severity_counts(alerts: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    return (alerts.filter(F.col("created_at") >= before(as_of, days=days))
            .groupBy(severity("kind").alias("severity")).agg(F.count(F.lit(1)).alias("count")))


def job_totals(runs: DataFrame) -> DataFrame:
    """Last run, runs, successes and failures per job."""
    return (runs.groupBy("job_name")
            .agg(F.max("ingested_at").alias("last_run"), F.count(F.lit(1)).alias("total_runs"),
                 count_where(F.col("status") == "SUCCESS").alias("success_count"),
                 count_where(F.col("status") != "SUCCESS").alias("failure_count"))
            .orderBy(F.desc("last_run"), "job_name"))


def ordered_rows(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The top rows with their position; the window sees at most ``limit`` rows, or all rows of a
    table that is small by nature (groups, series) where there is none."""
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return top(df, order, limit).withColumn("_position", position)


def context_json(df: DataFrame, order: Sequence[Column], cols: Sequence[str],
                 limit: int) -> DataFrame:
    """The top rows of a domain as one JSON array text (the limit bounds the array)."""
    entries = F.array_sort(F.collect_list(F.struct("_position", F.struct(*cols).alias("row"))))
    return ordered_rows(df, order, limit).agg(
        F.to_json(F.transform(entries, lambda entry: entry["row"])).alias("context"))
