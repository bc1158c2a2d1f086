"""Operations observability: usage log, job runs, alert log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import (alert_family, cost_band, duration_band, is_stale,
                                        latency_band, run_state)
from tidemark.operators.latest import latest_version


def count_where(condition: Column) -> Column:
    """SUM(CASE WHEN ... THEN 1 ELSE 0 END): null, not zero, when there are no rows."""
    return F.sum(F.when(condition, 1).otherwise(0))


def usage_normalized(df: DataFrame) -> DataFrame:
    event_time = F.col("event_time").cast("timestamp")
    return df.select(
        event_time.alias("event_time"),
        *[name for name in df.columns if name != "event_time"],
        F.date_trunc("HOUR", event_time).alias("hour_bucket"),
        F.date_trunc("DAY", event_time).alias("day_bucket"),
        latency_band("latency_ms").alias("latency_band"),
        cost_band("cost_estimate").alias("cost_band"),
        F.when(is_stale("freshness_watermark"), "stale").otherwise("fresh")
        .alias("freshness_state"))


def health_measures() -> list[Column]:
    """Aggregates of a usage group, shared by the batch and the streaming form."""
    status = F.col("response_status")
    return [
        F.count(F.lit(1)).alias("event_count"),
        *[count_where(status == name).alias(f"{name}_count") for name in fv.RESPONSE_STATUSES],
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        F.sum(F.coalesce("cost_estimate", F.lit(0.0))).alias("total_cost_estimate"),
        count_where(is_stale("freshness_watermark")).alias("stale_freshness_count")]


def route_health(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("route_selected", "hour_bucket").agg(*health_measures())


def release_readiness(health: DataFrame, policy: DataFrame, serving: DataFrame) -> DataFrame:
    """Health of a route and hour against its policy and the state of the gold tables.

    Broadcast sides: the policy (one row per route of a fixed list) and one row of totals.
    """
    gold = serving.agg(F.count(F.lit(1)).alias("gold_assets_total"),
                       count_where(F.col("serving_status") == "serve").alias("gold_assets_ready"))
    limits = policy.select(
        "route_selected", F.col("max_latency_ms").alias("policy_max_latency_ms"),
        F.col("max_cost_estimate").alias("policy_max_cost_estimate"),
        F.col("max_total_tokens").alias("policy_max_total_tokens"))
    ready = ((F.col("error_count") == 0)
             & (F.col("max_latency_ms") < F.col("policy_max_latency_ms"))
             & (F.col("total_cost_estimate") < F.col("policy_max_cost_estimate"))
             & (F.col("total_tokens") < F.col("policy_max_total_tokens"))
             & (F.col("stale_freshness_count") == 0)
             & (F.col("gold_assets_ready") == F.col("gold_assets_total")))
    return (health.join(limits, "route_selected").crossJoin(F.broadcast(gold))
            .withColumn("readiness_status", F.when(ready, "ready").otherwise("hold")))


def alert_queue(normalized: DataFrame) -> DataFrame:
    """Events that need attention, each with the first label that fits."""
    cost = F.coalesce("cost_estimate", F.lit(0.0))
    tokens = F.coalesce("total_tokens", F.lit(0))
    kind = (F.when(F.col("response_status") == "error", "error_spike")
            .when(F.col("latency_ms") >= 1000, "latency_breach")
            .when(cost >= 0.05, "cost_anomaly")
            .when(is_stale("freshness_watermark"), "freshness_gap")
            .when((F.col("route_selected") == "copilot") & (tokens >= 4000), "token_spike"))
    return (normalized.withColumn("alert_kind", kind).filter(F.col("alert_kind").isNotNull())
            .select("event_time", "request_id", "tenant_id", "route_selected",
                    "response_status", "latency_ms", "cost_estimate", "freshness_watermark",
                    "alert_kind"))


def runs_normalized(df: DataFrame) -> DataFrame:
    return df.select(
        "job_name", "run_id", F.upper("status").alias("status"),
        F.upper("result_state").alias("result_state"),
        F.col("update_time").cast("timestamp").alias("update_time"), "duration_ms",
        run_state("status").alias("run_state"), duration_band("duration_ms").alias("duration_band"))


def run_health(normalized: DataFrame) -> DataFrame:
    state = F.col("run_state")
    return normalized.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("run_count"),
        *[count_where(state == name).alias(f"{name}_count")
          for name in ("success", "failed", "cancelled", "running")],
        F.max("update_time").alias("latest_update_time"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.when(count_where(state.isin("failed", "cancelled")) == 0, "ready").otherwise("hold")
        .alias("bundle_readiness_status"))


def run_latest(normalized: DataFrame) -> DataFrame:
    """Latest run per job; equal times are decided by the run id."""
    return latest_version(normalized, ["job_name"],
                          [F.col("update_time").desc(), F.col("run_id").desc()])


def run_readiness(health: DataFrame, latest: DataFrame) -> DataFrame:
    last = latest.select("job_name", *[F.col(name).alias(f"latest_{name}") for name in (
        "run_id", "status", "result_state", "run_state")])
    return health.join(last, "job_name", "left").withColumn(
        "serving_status",
        F.when(F.col("bundle_readiness_status") == "ready", "serve").otherwise("hold"))


def alerts_normalized(df: DataFrame) -> DataFrame:
    return (df.withColumn("created_at", F.col("created_at").cast("timestamp"))
            .withColumn("alert_family", alert_family("kind")))


def alert_backlog_by_kind(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("kind", "alert_family").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("created_at").alias("latest_created_at"))


def alert_readiness(normalized: DataFrame) -> DataFrame:
    """Global state of the alert log; an empty log gives ``hold``."""
    run_alerts = count_where(F.col("kind").isin(fv.RUN_ALERTS))
    runtime = count_where(F.col("kind").isin(fv.RUNTIME_ALERTS))
    return normalized.agg(
        F.when((run_alerts == 0) & (runtime == 0), "ready").otherwise("hold").alias("alert_status"),
        F.count(F.lit(1)).alias("total_alerts"),
        count_where(F.col("alert_family") == "bundle").alias("bundle_alerts"),
        count_where(F.col("alert_family") == "runtime").alias("runtime_alerts"))


def ready_overview(readiness: DataFrame) -> DataFrame:
    status = F.col("readiness_status")
    return readiness.agg(
        F.count(F.lit(1)).alias("route_rows"),
        count_where(status == "ready").alias("ready_routes"),
        count_where(status == "hold").alias("hold_routes"),
        F.sum("event_count").alias("total_events"), F.sum("error_count").alias("total_errors"),
        F.sum("total_cost_estimate").alias("total_cost_estimate"),
        F.max("max_latency_ms").alias("peak_latency_ms"),
        F.sum("stale_freshness_count").alias("stale_freshness_count"))


def route_latest(readiness: DataFrame) -> DataFrame:
    return latest_version(readiness, ["route_selected"], [F.col("hour_bucket").desc()]).drop(
        "gold_assets_total", "gold_assets_ready")


def alert_backlog(queue: DataFrame) -> DataFrame:
    return (queue.groupBy("alert_kind", "route_selected")
            .agg(F.count(F.lit(1)).alias("alert_count"),
                 F.max("event_time").alias("latest_event_time"))
            .orderBy(F.desc("alert_count"), F.desc("latest_event_time")))


def cost_latency_trend(readiness: DataFrame) -> DataFrame:
    return (readiness.groupBy("route_selected", "hour_bucket")
            .agg(F.sum("event_count").alias("event_count"),
                 F.avg("avg_latency_ms").alias("avg_latency_ms"),
                 F.max("max_latency_ms").alias("max_latency_ms"),
                 F.sum("total_cost_estimate").alias("total_cost_estimate"),
                 F.sum("stale_freshness_count").alias("stale_freshness_count"))
            .orderBy(F.desc("hour_bucket"), "route_selected"))


def run_status(readiness: DataFrame) -> DataFrame:
    return readiness.select(
        "job_name", "bundle_readiness_status", "run_count", "success_count", "failed_count",
        "cancelled_count", "running_count", "latest_update_time", "max_duration_ms",
        "avg_duration_ms", "latest_run_id", "latest_status", "latest_result_state",
        "latest_run_state", "serving_status")


def alert_status(readiness: DataFrame) -> DataFrame:
    return readiness.select("alert_status", "total_alerts", "bundle_alerts", "runtime_alerts")
