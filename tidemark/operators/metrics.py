"""Figures of the dashboards, from the serving and operations tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import badge, blank_to_null
from tidemark.operators import serving
from tidemark.operators.silver import share_of_total


def _one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Side by side: every frame holds exactly one row."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


# Market page ---------------------------------------------------------------------------------------

def _section(df: DataFrame, order: Sequence[Column], limit: int | None, shown: int, name: str,
             fields: Sequence[Column]) -> DataFrame:
    rows = serving.ordered_rows(df, order, limit)
    entries = F.array_sort(F.collect_list(F.when(
        F.col("_position") <= shown, F.struct("_position", F.struct(*fields).alias("row")))))
    return rows.agg(F.transform(entries, lambda entry: entry["row"]).alias(name),
                    F.count(F.lit(1)).alias(f"_rows_{name}"),
                    F.max("observed_at").alias(f"_seen_{name}"))


class PageLimits(NamedTuple):
    """Rows a section of the market page takes (None: all) and shows."""

    rankings: tuple[int | None, int] = (100, 5)
    movers: tuple[int | None, int] = (10, 3)
    dominance: tuple[int | None, int] = (None, 4)
    comparisons: tuple[int | None, int] = (50, 3)


def market_overview(gold: Mapping[str, DataFrame], asset_ids: Sequence[str] | None = None,
                    limits: PageLimits = PageLimits()) -> DataFrame:
    """The market page as one row: counts, watermark, warnings and the JSON of four sections."""
    sets = serving.overview_datasets(dict(gold), asset_ids)
    asset = F.upper(F.coalesce(blank_to_null("symbol"), blank_to_null("asset_id"),
                               F.lit("UNKNOWN"))).alias("asset")
    c = F.col
    parts = [
        _section(sets["rankings"], serving.ranking_order(), *limits.rankings, "market_rankings",
                 [asset, c("name"), c("market_cap_rank"), c("market_cap_usd"), c("price_usd")]),
        _section(sets["movers"], serving.mover_order(), *limits.movers, "top_movers",
                 [asset, c("move_direction_24h").alias("direction"), c("price_change_pct_24h"),
                  c("move_band_24h")]),
        _section(sets["dominance"], [c("dominance_pct").desc(), c("dominance_group").asc()],
                 *limits.dominance, "dominance", [c("dominance_group").alias("group"), c("dominance_pct"),
                                  c("market_cap_usd")]),
        _section(sets["comparisons"], [c("market_cap_usd").desc(), c("asset_id").asc()],
                 *limits.comparisons, "comparisons", [asset, c("correlation_bucket"), c("price_change_pct_24h"),
                                 c("price_change_pct_7d")])]
    names = ["market_rankings", "top_movers", "dominance", "comparisons"]
    page = _one_row(parts).withColumn(
        "watermark", F.greatest(*[f"_seen_{name}" for name in names]))
    warnings = F.array_compact(F.array(
        F.when(c("_rows_market_rankings") == 0, "market_rankings_unavailable"),
        F.when(c("watermark").isNull(), "freshness_watermark_missing")))
    return page.select(
        c("_rows_market_rankings").alias("tracked_assets"),
        F.size("top_movers").alias("top_movers_visible"),
        F.size("dominance").alias("dominance_groups_visible"), "watermark",
        F.when(c("watermark").isNull(), "unknown").otherwise("ready").alias("freshness"),
        warnings.alias("warnings"), F.to_json(F.struct(*names)).alias("sections"))


def market_regime(macro: DataFrame) -> DataFrame:
    """Regime from the latest rate, inflation and money growth (one aggregate)."""
    name = F.lower("series_name")
    latest = lambda series: F.max_by(F.when(name == series, F.col("value")), F.when(
        name == series, F.col("observation_date")))
    values = macro.agg(latest("fed funds rate").alias("rate"), latest("cpi yoy").alias("cpi"),
                       latest("m2 growth").alias("money"))
    known = F.col("rate").isNotNull() & F.col("cpi").isNotNull() & F.col("money").isNotNull()
    return values.withColumn(
        "regime", F.when(~known, "unknown")
        .when((F.col("rate") <= 4.0) & (F.col("cpi") <= 3.0) & (F.col("money") >= 3.0), "risk_on")
        .when((F.col("rate") >= 4.5) | (F.col("cpi") >= 3.5), "defensive").otherwise("neutral"))


def watchlist(rankings: DataFrame, movers: DataFrame) -> DataFrame:
    """Best and worst 24 h move and the leader by rank; ties go to the smaller symbol."""
    change = F.col("price_change_pct_24h")
    row = F.struct("symbol", change.alias("change"))
    best = F.min_by(F.when(change > 0, row), F.when(change > 0, F.struct(-change, "symbol")))
    worst = F.min_by(F.when(change < 0, row), F.when(change < 0, F.struct(change, "symbol")))
    moves = movers.agg(best.alias("b"), worst.alias("w"))
    leader = rankings.agg(F.min_by("symbol", F.struct("market_cap_rank", "symbol")).alias("l"))
    return _one_row([leader, moves]).select(
        F.coalesce("l", F.lit("BTC")).alias("cap_leader"),
        F.col("b.symbol").alias("best_symbol"), F.col("b.change").alias("best_change"),
        F.col("w.symbol").alias("worst_symbol"), F.col("w.change").alias("worst_change"))


def series_arrays(macro: DataFrame, limit: int | None = None) -> DataFrame:
    """Dates and values per series, of all rows or of the newest ``limit``."""
    rows = serving.ordered_rows(macro, [F.col("observation_date").desc(), F.col("series_name")],
                                limit)
    entries = F.array_sort(F.collect_list(F.struct("_position", "observation_date", "value")))
    return rows.groupBy("series_name").agg(entries.alias("_e")).select(
        "series_name", F.transform("_e", lambda e: e["observation_date"]).alias("dates"),
        F.transform("_e", lambda e: e["value"]).alias("values"))


def rank_series(rankings: DataFrame) -> DataFrame:
    change = F.col("price_change_pct_24h")
    return rankings.select(
        F.coalesce("symbol", "asset_id").alias("label"),
        (F.col("market_cap_usd") / F.lit(1e9)).alias("market_cap_billion"),
        F.when(change > 0, "up").otherwise("down").alias("sign"))


# Usage pages ------------------------------------------------------------------------------------------

def tenant_activity(usage: DataFrame, recent: int | None = None) -> DataFrame:
    """Requests and last seen per tenant; ``recent`` looks at the newest events only."""
    rows = usage if recent is None else serving.top(
        usage, [F.desc("event_time"), F.asc("request_id")], recent)
    return (rows.groupBy(F.coalesce("tenant_id", F.lit("unknown")).alias("tenant_id"))
            .agg(F.count(F.lit(1)).alias("requests"), F.max("event_time").alias("last_seen"))
            .orderBy(F.desc("requests"), "tenant_id"))


def latency_quartiles(usage: DataFrame, tiers: Sequence[str] | None = None) -> DataFrame:
    """Box statistics per tier, of all tiers or those named. Latencies are counted per value first, so the percentile state
    is bounded by the distinct integer values and not by the rows."""
    rows = usage if tiers is None else usage.filter(F.col("model_tier").isin(list(tiers)))
    counts = (rows.filter(F.col("latency_ms").isNotNull())
              .groupBy("model_tier", "latency_ms").agg(F.count(F.lit(1)).alias("n")))
    at = F.percentile("latency_ms", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return counts.groupBy("model_tier").agg(
        F.min("latency_ms").alias("low"), at.alias("q"), F.max("latency_ms").alias("high"),
    ).select("model_tier", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
             F.col("q")[2].alias("q3"), "high")


def status_distribution(usage: DataFrame) -> DataFrame:
    rows = usage.select(F.coalesce("response_status", F.lit("unknown")).alias("s"),
                        F.lit(1).alias("requests"))
    return share_of_total(rows, [], F.col("s"), "response_status", "requests", "share_pct")


def _label(alerts: DataFrame) -> Column:
    names = [name for name in ("severity", "kind") if name in alerts.columns]
    return F.coalesce(*[blank_to_null(name) for name in names])


def alert_trend(alerts: DataFrame, ts: str = "created_at") -> DataFrame:
    classes = ["critical", "warning", "info"]
    return (alerts.withColumn("day", F.to_date(ts)).withColumn("class", badge(_label(alerts)))
            .groupBy("day").pivot("class", classes).agg(F.count(F.lit(1)))
            .na.fill(0, classes).orderBy("day"))


def alert_badges(alerts: DataFrame) -> DataFrame:
    weight = F.coalesce("count", F.lit(1)) if "count" in alerts.columns else F.lit(1)
    kind = badge(_label(alerts))
    return alerts.agg(*[F.coalesce(F.sum(F.when(kind == name, weight)), F.lit(0)).alias(name)
                        for name in ("critical", "warning", "info")])


def spend_kpis(tiers: DataFrame) -> DataFrame:
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    sums = tiers.agg(total("total_cost_usd").alias("total_cost_usd"),
                     total("total_tokens").alias("total_tokens"),
                     total("requests").alias("requests"))
    return sums.withColumn("cost_per_request",
                           F.col("total_cost_usd") / F.greatest("requests", F.lit(1)))


def daily_tier_matrix(daily: DataFrame,
                      tiers: Sequence[str] = tuple(fv.COST_PER_1K_TOKENS)) -> DataFrame:
    """Day by tier, missing cells 0. The fixed tier list saves the scan pivot would need; all other
    tiers add up in ``other``, so a row's sum is the day's spend."""
    names = [*tiers, "other"]
    tier = F.coalesce("model_tier", F.lit("standard"))
    filled = daily.withColumn("model_tier", F.when(tier.isin(list(tiers)), tier).otherwise("other"))
    return (filled.groupBy("day").pivot("model_tier", names).agg(F.sum("cost_usd"))
            .na.fill(0.0, names).orderBy("day"))


def assurance(checks: DataFrame, usage: DataFrame, runs: DataFrame,
              alerts: DataFrame) -> DataFrame:
    """Confidence in percent (passed checks, else share of successes) and active bugs."""
    n = lambda name: F.count(F.lit(1)).alias(name)
    rows = _one_row([
        checks.agg(n("_checks"), F.count_if(F.lower("status") == "pass").alias("_passed")),
        usage.agg(n("_events"),
                  F.count_if(F.lower("response_status") == "success").alias("_successes")),
        alerts.agg(F.count_if(F.lower("kind").isin(fv.HIGH_SEVERITY_KINDS)).alias("_bad_alerts")),
        runs.agg(F.count_if(~F.coalesce(F.upper("status").isin(fv.RUN_SUCCESS), F.lit(False)))
                 .alias("_bad_runs"))])
    share = lambda part, whole: F.bround(F.col(part) / F.col(whole) * 100, 0).cast("int")
    return rows.select(
        F.when(F.col("_checks") > 0, share("_passed", "_checks"))
        .when(F.col("_events") > 0, share("_successes", "_events")).otherwise(0)
        .alias("confidence_pct"),
        (F.col("_bad_alerts") + F.col("_bad_runs")).alias("active_bugs"))


# Operations pages -----------------------------------------------------------------------------------------

def resource_health(overview: DataFrame, routes: DataFrame, runs: DataFrame, alerts: DataFrame,
                    backlog: DataFrame, resources: DataFrame) -> DataFrame:
    """State and metric of every resource in the table ``resources`` (position, layer, resource,
    evidence, key); evidence is job, route, gold, jobs or alerts, and key names the job or route."""
    n0 = lambda name: F.coalesce(F.col(name), F.lit(0))
    job_rows = runs.select(
        F.lit("job").alias("evidence"), F.col("job_name").alias("key"),
        F.when((n0("failed_count") > 0) | (F.col("bundle_readiness_status") != "ready"),
               "critical").when(n0("running_count") > 0, "warning").otherwise("healthy")
        .alias("status"),
        F.format_string("ok=%d fail=%d", n0("success_count"), n0("failed_count")).alias("metric"))
    waiting = backlog.groupBy(F.col("route_selected").alias("key")).agg(
        F.sum("alert_count").alias("waiting"))
    route_rows = routes.select(
        F.lit("route").alias("evidence"), F.col("route_selected").alias("key"),
        F.when(F.col("readiness_status") == "ready", "healthy")
        .when(n0("error_count") > 0, "critical").otherwise("warning").alias("status"),
        F.format_string("lat=%dms cost=$%.4f ", n0("avg_latency_ms").cast("bigint"),
                        n0("total_cost_estimate").cast("double")).alias("metric"))
    all_jobs = runs.agg(
        F.coalesce(F.bool_and(F.col("bundle_readiness_status") == "ready"), F.lit(True))
        .alias("calm"))
    totals = _one_row([
        overview.agg(F.coalesce(F.max("stale_freshness_count"), F.lit(0)).alias("stale")),
        all_jobs, runs.agg(F.count(F.lit(1)).alias("jobs")),
        alerts.agg(F.max("alert_status").alias("alert_status"),
                   F.coalesce(F.max("runtime_alerts"), F.lit(0)).alias("runtime"),
                   F.coalesce(F.max("bundle_alerts"), F.lit(0)).alias("bundle"))])
    evidence, alerted = F.col("evidence"), F.coalesce("waiting", F.lit(0))
    joined = (resources.join(job_rows.unionByName(route_rows), ["evidence", "key"], "left")
              .join(waiting, "key", "left").crossJoin(F.broadcast(totals)))
    status = (F.when(evidence == "gold", F.when(F.col("stale") == 0, "healthy").otherwise("warning"))
              .when(evidence == "jobs", F.when(F.col("calm"), "healthy").otherwise("warning"))
              .when(evidence == "alerts", F.when(F.col("alert_status") == "ready", "healthy")
                    .otherwise("critical"))
              .otherwise(F.coalesce("status", F.lit("warning"))))
    metric = (F.when(evidence == "gold", F.format_string("stale=%d", "stale"))
              .when(evidence == "jobs", F.format_string("jobs=%d", "jobs"))
              .when(evidence == "alerts", F.format_string("runtime=%d bundle=%d", "runtime", "bundle"))
              .when(evidence == "job", F.coalesce("metric", F.lit("ok=0 fail=0")))
              .otherwise(F.concat(F.coalesce("metric", F.lit("")),
                                  F.format_string("alerts=%d", alerted))))
    return joined.select("position", "layer", "resource", status.alias("status"),
                         metric.alias("metric")).orderBy("position")


def health_kpis(resources: DataFrame, overview: DataFrame, tiers: DataFrame) -> DataFrame:
    rows = _one_row([
        resources.agg(*[F.count_if(F.col("status") == name).alias(name)
                        for name in ("healthy", "warning", "critical")]),
        overview.agg(F.coalesce(F.max("total_cost_estimate"), F.lit(0.0)).alias("_route_cost")),
        tiers.agg(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("_tier_cost"))])
    return rows.select("healthy", "warning", "critical",
                       (F.col("_route_cost") + F.col("_tier_cost")).alias("total_cost"))


def _items(rows: DataFrame, fallback: str, impact: str, limit: int | None) -> DataFrame:
    """Findings in order of priority, or the all-clear row where there are none."""
    none = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit(99).alias("priority"), F.lit("").alias("subject"), F.lit(fallback).alias("rule"),
        F.lit(impact).alias("impact"), F.lit(None).cast("double").alias("value"))
    return serving.top(rows.unionByName(none), [F.asc("priority"), F.asc("subject"),
                                                F.asc("rule")], limit)


def _finding(df: DataFrame, when: Column, priority: int, subject: Column, rule: str, impact: str,
             value: Column) -> DataFrame:
    return df.filter(when).select(
        F.lit(priority).alias("priority"), subject.alias("subject"), F.lit(rule).alias("rule"),
        F.lit(impact).alias("impact"), value.cast("double").alias("value"))


def _near_cost_limit() -> Column:
    policy = F.col("policy_max_cost_estimate")
    return (policy > 0) & (F.coalesce("total_cost_estimate", F.lit(0.0)) >= policy * 0.8)


def optimization_items(routes: DataFrame, runs: DataFrame, trend: DataFrame,
                       alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings on cost and operation, most important first; all, or the first ``limit``."""
    route, count = F.col("route_selected"), F.col("n")
    tally = lambda df, condition: df.agg(F.count_if(condition).alias("n"))
    rows = [
        _finding(routes, (route == "copilot") & _near_cost_limit(), 1, route,
                 "route_cost_near_limit", "high", F.col("total_cost_estimate")),
        _finding(routes, (route == "copilot") & (F.col("total_tokens") >= 3000), 2, route,
                 "long_prompts", "medium", F.col("total_tokens")),
        _finding(routes, (route == "genie") & (F.col("stale_freshness_count") > 0), 3, route,
                 "stale_reads", "high", F.col("stale_freshness_count")),
        _finding(tally(runs, F.col("failed_count") > 0), count > 0, 4, F.lit("jobs"),
                 "failed_jobs", "high", count),
        _finding(alerts, F.col("runtime_alerts") > 0, 5, F.lit("alerts"), "runtime_backlog",
                 "medium", F.col("runtime_alerts")),
        _finding(tally(trend, F.col("total_cost_estimate") >= 0.03), count > 0, 6,
                 F.lit("routes"), "costly_hours", "medium", count)]
    return _items(reduce(DataFrame.unionByName, rows), "all_clear", "low", limit)


def cost_items(routes: DataFrame, runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Cost findings per route, then failed jobs; all, or the first ``limit``."""
    route = F.col("route_selected")
    latency = F.coalesce("avg_latency_ms", F.lit(0)).cast("bigint")
    failed = runs.agg(F.count_if(F.col("failed_count") > 0).alias("n"))
    found = routes.select(route, F.explode(F.array_compact(F.array(
        F.when(_near_cost_limit(), F.struct(
            F.lit("cost_near_limit").alias("rule"), F.lit("warning").alias("impact"),
            F.col("total_cost_estimate").cast("double").alias("value"))),
        F.when(latency >= 1000, F.struct(
            F.lit("slow_route").alias("rule"), F.lit("danger").alias("impact"),
            latency.cast("double").alias("value")))))).alias("i"))
    rows = found.select(F.lit(1).alias("priority"), route.alias("subject"), "i.*").unionByName(
        _finding(failed, F.col("n") > 0, 2, F.lit("jobs"), "failed_jobs", "danger", F.col("n")))
    return _items(rows, "all_clear", "success", limit)


def infra_rows(routes: DataFrame, runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cost, latency and state of the named routes and of the jobs (longest mean duration)."""
    listed = routes.sparkSession.createDataFrame(
        list(enumerate(names, 1)), "position int, route_selected string")
    measured = listed.join(routes, "route_selected", "left").select(
        "position", F.col("route_selected").alias("resource"),
        F.coalesce("total_cost_estimate", F.lit(0.0)).alias("cost"),
        F.coalesce("avg_latency_ms", F.lit(0)).cast("bigint").alias("latency"),
        F.coalesce("readiness_status", F.lit("hold")).alias("status"))
    all_ready = F.coalesce(F.bool_and(F.col("bundle_readiness_status") == "ready"), F.lit(True))
    jobs = runs.agg(F.coalesce(F.max("avg_duration_ms"), F.lit(0)).cast("bigint").alias("latency"),
                    F.when(all_ready, "ready").otherwise("hold").alias("status")).select(
        F.lit(len(names) + 1).alias("position"), F.lit("jobs").alias("resource"), F.lit(0.0).alias("cost"),
        "latency", "status")
    return measured.unionByName(jobs).orderBy("position")


def success_series(totals: DataFrame) -> DataFrame:
    short = F.replace(F.replace("job_name", F.lit("_job"), F.lit("")), F.lit("_ingestion"), F.lit(""))
    return totals.select(short.alias("job"), "success_count", "failure_count")
