"""Alert evaluation and release readiness, distributed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import before, escalation, is_stale, labels_where, lookup, moment
from tidemark.sources.align import conform
from tidemark import schemas

AsOf = datetime | str | Column


def _recent(df: DataFrame, ts: str, as_of: AsOf, hours: float) -> DataFrame:
    return df.filter(F.col(ts) >= before(as_of, hours=hours))


def _as_alerts(df: DataFrame, as_of: AsOf, source: str = fv.EVALUATION_SOURCE) -> DataFrame:
    """Rows with ``kind``, ``message`` and any other alert columns, completed to the log schema."""
    return conform(df.withColumn("source", F.lit(source))
                   .withColumn("created_at", moment(as_of)), schemas.ALERTS)


def _usage_findings(usage: DataFrame, as_of: AsOf, hours: float, limit_pct: float, limit_ms: int, limit_usd: float,
                    kinds: Sequence[str]) -> DataFrame:
    """(kind, message) from one pass over the usage of the window.

    Events are counted per tier and latency (combined map-side). A scope is all events (null) or a tier; a window
    over its latencies, as many as the integers have and not as the events, gives the floor rank of the 95th percentile,
    and its first row carries the totals. Everything that is neither success nor partial is an error; a missing
    status too. Events without a latency count in the totals alone."""
    failed = ~F.coalesce(F.col("response_status").isin("success", "partial"), F.lit(False))
    tier = F.coalesce(F.nullif("model_tier", F.lit("")), F.lit("standard"))
    sums = (_recent(usage, "event_time", as_of, hours).groupBy(tier.alias("tier"), F.col("latency_ms").alias("latency"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors"), F.sum("cost_estimate").cast("double").alias("cost")))
    scoped = (sums.withColumn("scope", F.explode(F.array(F.lit(None).cast("string"), F.col("tier"))))
              .groupBy("scope", "latency").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "cost")]))
    scope = Window.partitionBy("scope")
    order = scope.orderBy(F.col("latency").asc_nulls_first())
    known = F.when(F.col("latency").isNotNull(), F.col("n")).otherwise(0)
    ranked = scoped.withColumns({
        "known": known, "upto": F.sum(known).over(order), "rank": F.greatest(F.lit(1), F.floor(F.sum(known).over(scope) * F.lit(0.95))),
        "nth": F.row_number().over(order), **{f"all_{c}": F.sum(c).over(scope) for c in ("n", "errors", "cost")}})
    rate = F.col("all_errors") / F.col("all_n") * 100
    total = F.col("scope").isNull() & (F.col("nth") == 1)
    slow = (F.col("latency") > limit_ms) & (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("known") < F.col("rank"))

    def alert(when: Column, kind: str, text: str, *values: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.format_string(text, *values).alias("message")))

    found = {
        "error": alert(total & (rate > limit_pct), "error_spike", f"Error rate %.1f%% exceeds threshold {limit_pct}%% "
                       "(%d/%d requests in window).", rate, "all_errors", "all_n"),
        "latency": alert(slow & F.col("scope").isNull(), "latency_breach", f"P95 latency %dms exceeds threshold {limit_ms}ms.", "latency"),
        "cost": alert(total & (F.col("all_cost") > limit_usd), "cost_anomaly",
                      f"Hourly cost $%.4f exceeds threshold ${limit_usd:.2f}.", "all_cost"),
        "tier": alert(slow & F.col("scope").isNotNull(), "latency_breach",
                      f"P95 latency for tier '%s' is %dms — exceeds {limit_ms}ms threshold.", "scope", "latency")}
    return ranked.select(F.explode(F.array_compact(F.array(*[found[k] for k in kinds]))).alias("a")).select("a.*")


def usage_alerts(usage: DataFrame, as_of: AsOf, hours: float = 1, limit_pct: float = 10.0, limit_ms: int = 5000,
                 limit_usd: float = 1.0, kinds: Sequence[str] = ("error", "latency", "cost", "tier")) -> DataFrame:
    """Alerts on error rate, latency, cost and latency per tier, read from one scan."""
    return _as_alerts(_usage_findings(usage, as_of, hours, limit_pct, limit_ms, limit_usd, kinds), as_of)


def error_rate_alerts(usage: DataFrame, as_of: AsOf, hours: float = 1, limit_pct: float = 10.0) -> DataFrame:
    return usage_alerts(usage, as_of, hours, limit_pct=limit_pct, kinds=["error"])


def latency_alerts(usage: DataFrame, as_of: AsOf, hours: float = 1, limit_ms: int = 5000) -> DataFrame:
    return usage_alerts(usage, as_of, hours, limit_ms=limit_ms, kinds=["latency"])


def tier_latency_alerts(usage: DataFrame, as_of: AsOf, hours: float = 1, limit_ms: int = 5000) -> DataFrame:
    return usage_alerts(usage, as_of, hours, limit_ms=limit_ms, kinds=["tier"])


def cost_alerts(usage: DataFrame, as_of: AsOf, hours: float = 1, limit_usd: float = 1.0) -> DataFrame:
    return usage_alerts(usage, as_of, hours, limit_usd=limit_usd, kinds=["cost"])


def run_alerts(runs: DataFrame, as_of: AsOf, hours: float = 1) -> DataFrame:
    status, job = F.upper("status"), F.coalesce("job_name", F.lit("unknown"))
    kind = (F.when(status == "FAILED", "bundle_failure")
            .when(status == "CANCELLED", "bundle_cancelled"))
    ending = F.when(status == "FAILED", "failed").otherwise("was cancelled")
    alerts = _recent(runs, "ingested_at", as_of, hours).withColumn("kind", kind)
    return _as_alerts(alerts.filter(F.col("kind").isNotNull()).select(
        "kind", F.format_string("Job %s run %s %s.", job, F.coalesce("run_id", F.lit("None")),
                                ending).alias("message"),
        job.alias("job_name"), "run_id"), as_of)


def evaluate_alerts(usage: DataFrame, runs: DataFrame, as_of: AsOf,
                    hours: float = 1) -> DataFrame:
    """All alerts of the window, ready to append, with the ones to announce marked."""
    return usage_alerts(usage, as_of, hours).unionByName(run_alerts(runs, as_of, hours)).withColumn(
        "high_severity", F.col("kind").isin(fv.HIGH_SEVERITY_KINDS))


# Event analysis ----------------------------------------------------------------------------------

def _event_kinds() -> Column:
    cost, tokens = F.coalesce("cost_estimate", F.lit(0.0)), F.coalesce("total_tokens", F.lit(0))
    return labels_where([
        (F.col("response_status") == "error", "error_spike"),
        (F.coalesce("latency_ms", F.lit(0)) >= 1000, "latency_breach"),
        (cost >= 0.05, "cost_anomaly"),
        (is_stale("freshness_watermark"), "freshness_gap"),
        ((F.col("route_selected") == "copilot") & (tokens >= 4000), "token_spike")])


def event_alerts(usage: DataFrame) -> DataFrame:
    """Every label that fits an event, one row each (up to five)."""
    return usage.select(F.explode(_event_kinds()).alias("kind"), "request_id", "tenant_id",
                        F.coalesce("route_selected", F.lit("unknown")).alias("route_selected"),
                        ).withColumn("message", lookup("kind", fv.ALERT_MESSAGES))


def usage_summary(usage: DataFrame) -> DataFrame:
    status = F.col("response_status")
    return usage.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(status == "error").alias("errors"),
        F.count_if(status == "partial").alias("partials"),
        F.count_if(status == "refused").alias("refusals"),
        F.greatest(F.coalesce(F.max("latency_ms"), F.lit(0)), F.lit(0)).alias("max_latency_ms"),
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("total_cost_estimate"),
        F.coalesce(F.sum(F.size(_event_kinds())), F.lit(0)).alias("alerts"))


def _run_class() -> Column:
    status = F.upper(F.coalesce("status", F.lit("unknown")))
    return (F.when(status.isin(fv.RUN_SUCCESS), "success")
            .when(status.isin(fv.RUN_ACTIVE), "running")
            .when(status.isin(fv.RUN_CANCELLED), "cancelled").otherwise("failed"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals of the runs; cancelled ones and unknown states count as failures."""
    state = _run_class()
    failures = F.count_if(state.isin("cancelled", "failed"))
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(state == "success").alias("successes"),
        failures.alias("failures"), F.count_if(state == "running").alias("running"),
        F.count_if(state == "cancelled").alias("cancelled"), failures.alias("alerts"))


def run_event_alerts(runs: DataFrame) -> DataFrame:
    state, job = _run_class(), F.coalesce("job_name", F.lit("unknown"))
    kind = F.when(state == "cancelled", "bundle_cancelled").when(state == "failed", "bundle_failure")
    ending = F.when(state == "cancelled", "was cancelled").otherwise("failed")
    return (runs.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .select("kind", job.alias("job_name"), "run_id",
                    F.format_string(fv.RUN_EVENT_MESSAGE, job, ending)
                    .alias("message")))


# Readiness -----------------------------------------------------------------------------------------

def layered_policy(policy: DataFrame, overrides: DataFrame | None = None,
                   default_latency: int = 1000, default_cost: float = 0.05,
                   default_tokens: int = 4000) -> tuple[DataFrame, dict[str, Column]]:
    """Route limits with overrides on top, and the global limits for routes without any.

    Returns the policy rows and, per limit, the expression to use after a left join with them.
    """
    limits = ["max_latency_ms", "max_cost_estimate", "max_total_tokens"]
    if overrides is not None:
        over = overrides.select("route_selected", *[F.col(n).alias(f"_{n}") for n in limits])
        policy = policy.join(over, "route_selected", "full").select(
            "route_selected", *[F.coalesce(f"_{n}", n).alias(n) for n in limits])
    defaults = [default_latency, default_cost, default_tokens]
    return policy, {n: F.coalesce(n, F.lit(d)) for n, d in zip(limits, defaults)}


def threshold_checks(usage: DataFrame, policy: DataFrame, overrides: DataFrame | None = None,
                     require_freshness: bool = True, **defaults: float) -> DataFrame:
    """Five checks per event against the limits of its route, with the blocker a failed one
    raises. The policy has one row per route."""
    rows, limit = layered_policy(policy, overrides, **defaults)
    route = F.coalesce("route_selected", F.lit("unknown"))
    latency = F.coalesce("latency_ms", F.lit(0))
    cost = F.coalesce("cost_estimate", F.lit(0.0))
    tokens = F.coalesce("total_tokens", F.lit(0))
    status = F.coalesce("response_status", F.lit("unknown"))
    fresh = ~is_stale("freshness_watermark") if require_freshness else F.lit(True)

    def one(name: str, passed: Column, value: Column, threshold: Column, kind: str) -> Column:
        return F.struct(
            F.concat(route, F.lit(f"_{name}")).alias("name"),
            F.when(passed, "pass").otherwise("fail").alias("status"),
            value.cast("string").alias("value"), threshold.cast("string").alias("threshold"),
            F.when(~passed, kind).alias("blocker_kind"))

    checks = F.array(
        one("latency_within_threshold", latency < limit["max_latency_ms"], latency,
            limit["max_latency_ms"], "latency_breach"),
        one("cost_within_threshold", cost < limit["max_cost_estimate"], cost,
            limit["max_cost_estimate"], "cost_anomaly"),
        one("tokens_within_threshold", tokens < limit["max_total_tokens"], tokens,
            limit["max_total_tokens"], "token_spike"),
        one("freshness_valid", fresh, F.col("freshness_watermark"),
            F.lit("required" if require_freshness else "optional"), "freshness_gap"),
        one("status_ok", status != "error", status, F.lit("success"), "error_spike"))
    return (usage.join(rows, "route_selected", "left")
            .select("request_id", "tenant_id", route.alias("route_selected"),
                    F.explode(checks).alias("c"))
            .select("request_id", "tenant_id", "route_selected", "c.*"))


def _summary_checks(usage: DataFrame, runs: DataFrame | None) -> DataFrame:
    def rows(totals: DataFrame, entries: list[tuple[str, Column, Column, str]]) -> DataFrame:
        structs = [F.struct(F.lit(name).alias("name"),
                            F.when(passed, "pass").otherwise("fail").alias("status"),
                            value.cast("string").alias("value"),
                            F.lit(threshold).alias("threshold"))
                   for name, passed, value, threshold in entries]
        return totals.select(F.inline(F.array(*structs)))

    present = F.col("events") > 0
    checks = rows(usage_summary(usage), [
        ("telemetry_present", present, present.cast("int"), "at_least_one_event"),
        ("error_free", F.col("errors") == 0, F.col("errors"), "0"),
        ("alert_free", F.col("alerts") == 0, F.col("alerts"), "0")])
    if runs is None:
        return checks
    return checks.unionByName(rows(run_summary(runs), [
        ("bundle_runs_failure_free", F.col("failures") == 0, F.col("failures"), "0")]))


def readiness_checks(usage: DataFrame, policy: DataFrame, runs: DataFrame | None = None,
                     **options) -> DataFrame:
    """All checks of a release as rows: totals and five per event."""
    per_event = threshold_checks(usage, policy, **options).select(
        "name", "status", "value", "threshold")
    return _summary_checks(usage, runs).unionByName(per_event)


def readiness_blockers(usage: DataFrame, policy: DataFrame, runs: DataFrame | None = None,
                       **options) -> DataFrame:
    """What holds a release back, one row per finding, with its escalation."""
    columns = ["kind", "request_id", "tenant_id", "route_selected", "job_name", "run_id",
               "message"]
    text = lambda: F.lit(None).cast("string")
    no_job = {"job_name": text(), "run_id": text()}
    nothing = usage.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit("missing_telemetry").alias("kind"),
        F.lit("No telemetry events were provided.").alias("message")).withColumns(
        {"request_id": text(), "tenant_id": text(), "route_selected": text(), **no_job})
    errors = event_alerts(usage).filter(F.col("kind") == "error_spike").withColumns(no_job)
    limits = (threshold_checks(usage, policy, **options)
              .filter(F.col("blocker_kind").isNotNull())
              .withColumn("kind", F.col("blocker_kind"))
              .withColumn("message", lookup("kind", fv.BLOCKER_MESSAGES)).withColumns(no_job))
    parts = [nothing, errors, limits]
    if runs is not None:
        parts.append(run_event_alerts(runs).withColumns(
            {"request_id": text(), "tenant_id": text(), "route_selected": text()}))
    return (reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])
            .withColumn("escalation", escalation("kind")))


def readiness_score(checks: DataFrame, blockers: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: score, ready flag and state. Missing telemetry alone does not hold a release
    whose runs are healthy. Blockers are reduced to counts before they meet the rest."""
    passed = F.count_if(F.col("status") == "pass")
    total = F.count(F.lit(1))
    score = checks.agg(F.coalesce(F.when(total > 0, F.bround(passed / total * 100, 0)),
                                  F.lit(0.0)).cast("int").alias("score"))
    held = blockers.agg(F.count(F.lit(1)).alias("blockers"), F.count_if(
        F.col("kind") != "missing_telemetry").alias("_other"))
    healthy = runs.agg(F.coalesce(F.bool_and(F.coalesce(
        F.upper("status").isin(fv.RUN_SUCCESS), F.lit(False))), F.lit(True)).alias("_healthy"))
    limited = (F.col("blockers") > 0) & (F.col("_other") == 0) & F.col("_healthy")
    return (score.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(healthy))
            .select("score", F.when(limited, 0).otherwise(F.col("blockers")).alias("blockers"),
                    ((F.col("blockers") == 0) | limited).alias("ready"),
                    F.when(limited, "monitoring_limited").otherwise("normal")
                    .alias("operational_state")))


def evaluate_readiness(usage: DataFrame, policy: DataFrame, runs: DataFrame | None = None,
                       **options) -> dict[str, DataFrame]:
    blockers = readiness_blockers(usage, policy, runs, **options)
    return {"checks": readiness_checks(usage, policy, runs, **options), "blockers": blockers,
            "ready": blockers.agg((F.count(F.lit(1)) == 0).alias("ready"))}


