"""Operations, alert, serving and dashboard queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import escalation
from tidemark.operators import alerts, gold, metrics, ops, percentiles, serving
from tidemark.operators.freshness import union_all
from tidemark.sources import readers
from tidemark.workload.roles import AS_OF, ORDERS_AS_OF
from tidemark.workload.views import Views, n, sql

QUERIES: dict = {}

_LAST_DAY = f"TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"
_RUN_DAY = f"TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 240 HOUR"


def query(name: str, text: str | None = None, round6: str = ""):
    def register(build):
        QUERIES[name] = (build, sql(text, round6) if text else None)
        return build
    return register


# Observability ------------------------------------------------------------------------------------

@query("usage_normalized", "SELECT * FROM usage_n", "cost_estimate")
def _(v: Views):
    return ops.usage_normalized(v.role("usage"))


@query("route_health", "SELECT * FROM health", "avg_latency_ms total_cost_estimate")
def _(v: Views):
    return v.health


@query("release_readiness", "SELECT * FROM release", "avg_latency_ms total_cost_estimate")
def _(v: Views):
    return v.release


@query("alert_queue", "SELECT * FROM queue", "cost_estimate")
def _(v: Views):
    return v.queue


@query("runs_normalized", "SELECT * FROM runs_n")
def _(v: Views):
    return v.runs_n


@query("run_health", "SELECT * FROM runs_h", "avg_duration_ms")
def _(v: Views):
    return ops.run_health(v.runs_n)


@query("run_latest", "SELECT * FROM runs_l")
def _(v: Views):
    return ops.run_latest(v.runs_n)


@query("run_readiness", "SELECT * FROM runs_r", "avg_duration_ms")
def _(v: Views):
    return v.run_readiness


@query("alerts_normalized", "SELECT * FROM alerts_n")
def _(v: Views):
    return ops.alerts_normalized(v.role("alerts"))


@query("alert_backlog_by_kind", "SELECT kind, alert_family, count(*) AS alert_count, "
       "max(created_at) AS latest_created_at FROM alerts_n GROUP BY kind, alert_family")
def _(v: Views):
    return ops.alert_backlog_by_kind(ops.alerts_normalized(v.role("alerts")))


@query("alert_readiness", "SELECT * FROM alerts_r")
def _(v: Views):
    return v.alert_readiness


@query("ready_overview", "SELECT * FROM overview", "total_cost_estimate")
def _(v: Views):
    return ops.ready_overview(v.release)


@query("route_latest", "SELECT * FROM routes", "avg_latency_ms total_cost_estimate")
def _(v: Views):
    return ops.route_latest(v.release)


@query("alert_backlog", "SELECT * FROM backlog")
def _(v: Views):
    return ops.alert_backlog(v.queue)


@query("cost_latency_trend", "SELECT * FROM trend", "avg_latency_ms total_cost_estimate")
def _(v: Views):
    return ops.cost_latency_trend(v.release)


@query("run_status", "SELECT * FROM runs_r", "avg_duration_ms")
def _(v: Views):
    return ops.run_status(v.run_readiness)


@query("alert_status", "SELECT * FROM alerts_r")
def _(v: Views):
    return ops.alert_status(v.alert_readiness)


# Alert evaluation ------------------------------------------------------------------------------------


_RATE = f"""SELECT count(*) AS n, count(*) FILTER (response_status NOT IN ('success', 'partial'))
  AS e, sum(cost_estimate) AS cost FROM usage WHERE event_time >= {_LAST_DAY}"""
_ERRORS = f"""SELECT 'error_spike' AS kind, printf('Error rate %.1f%% exceeds threshold 10.0%% (%d/%d requests in window).',
  e / n * 100, e, n) AS message FROM ({_RATE}) WHERE e / n * 100 > 10"""
_COST = f"""SELECT 'cost_anomaly' AS kind, printf('Hourly cost $%.4f exceeds threshold $1.00.', cost) AS message
  FROM ({_RATE}) WHERE cost > 1.0"""


def _p95(group: str, where: str) -> str:
    return f"""SELECT {group} AS g, latency_ms AS p FROM usage WHERE {where} AND latency_ms IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY latency_ms)
        = greatest(1, CAST(floor(count(*) OVER (PARTITION BY {group}) * 0.95::DOUBLE) AS BIGINT))"""


_LATENCY = f"""SELECT 'latency_breach' AS kind, 'P95 latency ' || p || 'ms exceeds threshold 5000ms.' AS message
  FROM ({_p95('1', f'event_time >= {_LAST_DAY}')}) WHERE p > 5000"""
_TIERS = f"""SELECT 'latency_breach' AS kind, 'P95 latency for tier ''' || g || ''' is ' || p
  || 'ms — exceeds 5000ms threshold.' AS message
  FROM ({_p95("coalesce(model_tier, 'standard')", f'event_time >= {_LAST_DAY}')}) WHERE p > 5000"""
_RUNS = f"""SELECT CASE status WHEN 'FAILED' THEN 'bundle_failure' ELSE 'bundle_cancelled' END AS kind,
  'Job ' || job_name || ' run ' || run_id || CASE status WHEN 'FAILED' THEN ' failed.'
    ELSE ' was cancelled.' END AS message, job_name, run_id FROM runs
  WHERE status IN ('FAILED', 'CANCELLED') AND ingested_at >= {_RUN_DAY}"""


@query("error_rate_alerts", _ERRORS)
def _(v: Views):
    return alerts.error_rate_alerts(v.role("usage"), AS_OF, 24).select("kind", "message")


@query("p95_floor", _p95("event_type", "TRUE").replace("FROM usage", "FROM (SELECT event_type, "
       "CAST(round(value * 4000, 0) AS INT) AS latency_ms FROM events)"))
def _(v: Views):
    rows = readers.read_table(v.spark, v.folder, "events").selectExpr(
        "event_type AS g", "CAST(round(value * 4000, 0) AS INT) AS latency_ms")
    return percentiles.p95_floor(rows, ["g"], "latency_ms").withColumnRenamed("p95_latency_ms", "p")


@query("latency_alerts", _LATENCY)
def _(v: Views):
    return alerts.latency_alerts(v.role("usage"), AS_OF, 24).select("kind", "message")


@query("cost_alerts", _COST)
def _(v: Views):
    return alerts.cost_alerts(v.role("usage"), AS_OF, 24).select("kind", "message")


@query("tier_latency_alerts", _TIERS)
def _(v: Views):
    return alerts.tier_latency_alerts(v.role("usage"), AS_OF, 24).select("kind", "message")


@query("run_alerts", _RUNS)
def _(v: Views):
    return alerts.run_alerts(v.role("runs"), ORDERS_AS_OF, 240).select(
        "kind", "message", "job_name", "run_id")


@query("evaluate_alerts", f"""
  SELECT kind, message, kind IN ('bundle_failure', 'bundle_cancelled', 'error_spike')
    AS high_severity FROM ({_ERRORS} UNION ALL {_LATENCY} UNION ALL {_COST} UNION ALL {_TIERS}
    UNION ALL SELECT kind, message FROM ({_RUNS.replace(_RUN_DAY, _LAST_DAY)}))""")
def _(v: Views):
    return alerts.evaluate_alerts(v.role("usage"), v.role("runs"), AS_OF, 24).select(
        "kind", "message", "high_severity")


_MESSAGES = """CASE kind WHEN 'error_spike' THEN 'Response errors detected for this route.'
  WHEN 'latency_breach' THEN 'Latency exceeded the operational threshold.'
  WHEN 'cost_anomaly' THEN 'Estimated cost exceeded the target threshold.'
  WHEN 'freshness_gap' THEN 'Freshness metadata is missing or stale.'
  WHEN 'token_spike' THEN 'Token usage is above the expected copilot bound.' END"""


@query("event_alerts", f"SELECT kind, request_id, tenant_id, route_selected, {_MESSAGES} AS message "
       "FROM events_kinds")
def _(v: Views):
    return alerts.event_alerts(v.role("usage"))


_SUMMARY = """SELECT count(*) AS events, count(*) FILTER (response_status = 'error') AS errors,
  count(*) FILTER (response_status = 'partial') AS partials,
  count(*) FILTER (response_status = 'refused') AS refusals, max(latency_ms) AS max_latency_ms,
  sum(cost_estimate) AS total_cost_estimate, (SELECT count(*) FROM events_kinds) AS alerts
  FROM usage"""


@query("usage_summary", _SUMMARY, "total_cost_estimate")
def _(v: Views):
    return alerts.usage_summary(v.role("usage"))


_RUN_SUMMARY = """SELECT count(*) AS runs, count(*) FILTER (status = 'SUCCESS') AS successes,
  count(*) FILTER (status IN ('FAILED', 'CANCELLED')) AS failures,
  count(*) FILTER (status = 'RUNNING') AS running,
  count(*) FILTER (status = 'CANCELLED') AS cancelled,
  count(*) FILTER (status IN ('FAILED', 'CANCELLED')) AS alerts FROM runs"""


@query("run_summary", _RUN_SUMMARY)
def _(v: Views):
    return alerts.run_summary(v.role("runs"))


_CHECKED = """SELECT u.*, coalesce(total_tokens, 0) AS tk, coalesce(cost_estimate, 0) AS cost,
  policy_max_latency_ms AS ml, policy_max_cost_estimate AS mc, policy_max_total_tokens AS mt,
  (freshness_watermark IS NULL OR freshness_watermark IN ('', 'unknown', 'pending')) AS stale
  FROM usage u LEFT JOIN policy USING (route_selected)"""


def _one_check(name: str, ok: str, value: str, limit: str) -> str:
    return (f"SELECT request_id, route_selected || '_{name}' AS name, "
            f"CASE WHEN {ok} THEN 'pass' ELSE 'fail' END AS status, {value} AS value, "
            f"{limit} AS threshold FROM ({_CHECKED})")


_CHECKS = " UNION ALL ".join([
    _one_check("latency_within_threshold", "latency_ms < ml", "CAST(latency_ms AS STRING)", "CAST(ml AS STRING)"),
    _one_check("cost_within_threshold", "cost < mc", "NULL", "CAST(mc AS STRING)"),
    _one_check("tokens_within_threshold", "tk < mt", "CAST(tk AS STRING)", "CAST(mt AS STRING)"),
    _one_check("freshness_valid", "NOT stale", "freshness_watermark", "'required'"),
    _one_check("status_ok", "response_status <> 'error'", "response_status", "'success'")])


@query("threshold_checks", _CHECKS)
def _(v: Views):
    rows = alerts.threshold_checks(v.role("usage"), readers.route_policy(v.spark))
    cost = F.col("name").endswith("_cost_within_threshold")
    # the text form of a double is the engine's own, so the cost value is left out here
    return rows.select("request_id", "name", "status",
                       F.when(~cost, F.col("value")).alias("value"), "threshold")


_ALL_CHECKS = f"""SELECT regexp_replace(name, '^.*_(latency|cost|tokens|freshness|status)_', '\\1_')
    AS name, status FROM ({_CHECKS})
  UNION ALL SELECT 'telemetry_present', CASE WHEN events > 0 THEN 'pass' ELSE 'fail' END FROM ({_SUMMARY})
  UNION ALL SELECT 'error_free', CASE WHEN errors = 0 THEN 'pass' ELSE 'fail' END FROM ({_SUMMARY})
  UNION ALL SELECT 'alert_free', CASE WHEN alerts = 0 THEN 'pass' ELSE 'fail' END FROM ({_SUMMARY})
  UNION ALL SELECT 'bundle_runs_failure_free', CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END
    FROM ({_RUN_SUMMARY})"""


@query("readiness_checks", f"SELECT name, status, count(*) AS n FROM ({_ALL_CHECKS}) GROUP BY 1, 2")
def _(v: Views):
    checks = alerts.readiness_checks(v.role("usage"), readers.route_policy(v.spark), v.role("runs"))
    short = F.regexp_replace("name", "^.*_(latency|cost|tokens|freshness|status)_", "$1_")
    return checks.groupBy(short.alias("name"), "status").agg(F.count(F.lit(1)).alias("n"))


_BLOCK = {"latency_breach": "latency_ms >= ml", "cost_anomaly": "cost >= mc",
          "token_spike": "tk >= mt", "freshness_gap": "stale",
          "error_spike": "response_status = 'error'"}
_BLOCK_MESSAGES = """CASE kind WHEN 'latency_breach' THEN 'Route latency exceeded readiness threshold.'
  WHEN 'cost_anomaly' THEN 'Route cost exceeded readiness threshold.'
  WHEN 'token_spike' THEN 'Route token usage exceeded readiness threshold.'
  WHEN 'freshness_gap' THEN 'Freshness metadata is missing or stale.'
  ELSE 'Route returned an error status.' END"""
_ESCALATION = """CASE kind WHEN 'error_spike' THEN 'page_oncall'
  WHEN 'latency_breach' THEN 'investigate_performance' WHEN 'cost_anomaly' THEN 'review_budget'
  WHEN 'freshness_gap' THEN 'block_release' WHEN 'token_spike' THEN 'review_model_usage'
  WHEN 'missing_telemetry' THEN 'block_release' WHEN 'bundle_failure' THEN 'page_oncall'
  WHEN 'bundle_cancelled' THEN 'page_oncall' ELSE 'review' END"""
_BLOCKERS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, request_id, tenant_id, route_selected, NULL AS job_name, "
    f"NULL AS run_id FROM ({_CHECKED}) WHERE {condition}" for kind, condition in _BLOCK.items())
_BLOCKERS = f"""SELECT *, {_BLOCK_MESSAGES} AS message FROM ({_BLOCKERS})
  UNION ALL SELECT kind, request_id, tenant_id, route_selected, NULL, NULL,
    'Response errors detected for this route.' FROM events_kinds WHERE kind = 'error_spike'
  UNION ALL SELECT CASE status WHEN 'FAILED' THEN 'bundle_failure' ELSE 'bundle_cancelled' END,
    NULL, NULL, NULL, job_name, run_id, 'Databricks bundle job ' || job_name
    || CASE status WHEN 'FAILED' THEN ' failed.' ELSE ' was cancelled.' END
  FROM runs WHERE status IN ('FAILED', 'CANCELLED')"""


@query("readiness_blockers", f"SELECT *, {_ESCALATION} AS escalation FROM ({_BLOCKERS})")
def _(v: Views):
    return alerts.readiness_blockers(v.role("usage"), readers.route_policy(v.spark), v.role("runs"))


@query("escalation", f"SELECT kind, {_ESCALATION} AS escalation, count(*) AS n FROM alerts GROUP BY kind")
def _(v: Views):
    return (v.role("alerts").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("escalation", escalation("kind")))


@query("readiness_score", f"""
  SELECT CAST(round_even((SELECT count(*) FILTER (status = 'pass') / count(*) * 100
    FROM ({_ALL_CHECKS})), 0) AS INT) AS score, (SELECT count(*) FROM ({_BLOCKERS})) AS blockers,
    FALSE AS ready, 'normal' AS operational_state""")
def _(v: Views):
    usage, runs, policy = v.role("usage"), v.role("runs"), readers.route_policy(v.spark)
    return alerts.readiness_score(alerts.readiness_checks(usage, policy, runs),
                                  alerts.readiness_blockers(usage, policy, runs), runs)


# Serving ----------------------------------------------------------------------------------------------

_MOVER = ("asset_id, symbol, name, observed_at, window_id, price_change_pct_1h, "
          "price_change_pct_24h, price_change_pct_7d, volume_24h_usd, market_cap_usd, "
          "move_direction_24h, move_band_24h, quality_status")
_RANK = ("asset_id, symbol, name, category, observed_at, market_cap_usd, price_usd, "
         "volume_24h_usd, circulating_supply, market_cap_rank, freshness_tier, quality_status")
_COMPARE = ("asset_id, symbol, observed_at, price_usd, market_cap_usd, volume_24h_usd, "
            "price_change_pct_24h, price_change_pct_7d, correlation_bucket, quality_status")
_T_RANKINGS = f"""SELECT {_RANK} FROM g_rankings WHERE quality_status = 'pass'
  ORDER BY market_cap_rank, observed_at DESC, asset_id LIMIT 100"""
_T_MOVERS = f"""SELECT {_MOVER} FROM g_movers WHERE quality_status = 'pass' AND observed_at =
  (SELECT max(observed_at) FROM g_movers WHERE quality_status = 'pass')
  ORDER BY abs(price_change_pct_24h) DESC, asset_id LIMIT 10"""
_T_DOMINANCE = """SELECT observed_at, dominance_group, market_cap_usd, dominance_pct,
  dominance_band, quality_status FROM g_dominance WHERE quality_status = 'pass' AND observed_at =
  (SELECT max(observed_at) FROM g_dominance WHERE quality_status = 'pass')"""
_T_COMPARISON = f"""SELECT {_COMPARE} FROM g_comparison WHERE quality_status = 'pass'
  AND observed_at = (SELECT max(observed_at) FROM g_comparison WHERE quality_status = 'pass')
  ORDER BY market_cap_usd DESC, asset_id LIMIT 50"""
_PCT3 = "price_change_pct_1h price_change_pct_24h price_change_pct_7d"


@query("top_rankings", _T_RANKINGS)
def _(v: Views):
    return serving.top_rankings(v.gold["rankings"])


@query("app_rankings", """SELECT asset_id, symbol, name, price_usd,
  CAST(NULL AS DOUBLE) AS price_change_pct_24h, market_cap_usd, volume_24h_usd, market_cap_rank,
  observed_at FROM g_rankings ORDER BY market_cap_rank, observed_at DESC, asset_id LIMIT 12""")
def _(v: Views):
    return serving.app_rankings(v.gold["rankings"])


@query("latest_movers", _T_MOVERS, _PCT3)
def _(v: Views):
    return serving.latest_movers(v.gold["movers"])


_FALLBACK = ("price_change_pct_24h, price_change_pct_7d, volume_24h_usd, market_cap_usd")
_BY_SIZE = ("ORDER BY abs(price_change_pct_24h) DESC NULLS LAST, asset_id, volume_24h_usd DESC, "
            "market_cap_usd DESC LIMIT 10")


@query("movers_or_fallback", f"SELECT asset_id, symbol, name, {_FALLBACK} FROM g_movers {_BY_SIZE}",
       "price_change_pct_24h price_change_pct_7d")
def _(v: Views):
    return serving.movers_or_fallback(v.gold["movers"], v.gold["comparison"])


@query("movers_fallback_used", f"SELECT asset_id, symbol, asset_id AS name, {_FALLBACK} "
       f"FROM g_comparison {_BY_SIZE}")
def _(v: Views):
    nothing = v.gold["movers"].filter("market_cap_usd > 1e18")
    return serving.movers_or_fallback(nothing, v.gold["comparison"])


@query("latest_dominance", _T_DOMINANCE, "market_cap_usd dominance_pct")
def _(v: Views):
    return serving.latest_dominance(v.gold["dominance"])


@query("latest_comparison", _T_COMPARISON)
def _(v: Views):
    return serving.latest_comparison(v.gold["comparison"])


_ASSETS = [f"asset-{i}" for i in range(100)]


@query("latest_comparison_of_assets", _T_COMPARISON.replace(
    "ORDER BY", f"AND asset_id IN ({', '.join(repr(a) for a in _ASSETS)}) ORDER BY"))
def _(v: Views):
    return serving.latest_comparison(v.gold["comparison"], _ASSETS)


@query("overview_datasets", f"""
  SELECT 'rankings' AS dataset, count(*) AS n, max(observed_at) AS seen FROM ({_T_RANKINGS})
  UNION ALL SELECT 'movers', count(*), max(observed_at) FROM ({_T_MOVERS})
  UNION ALL SELECT 'dominance', count(*), max(observed_at) FROM ({_T_DOMINANCE})
  UNION ALL SELECT 'comparisons', count(*), max(observed_at) FROM ({_T_COMPARISON})""")
def _(v: Views):
    return union_all([df.agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("seen"))
                      .select(F.lit(name).alias("dataset"), "n", "seen")
                      for name, df in serving.overview_datasets(v.gold).items()])


@query("top_protocols", """SELECT protocol_slug, name AS protocol_name, tvl_usd, fees_24h_usd,
  revenue_24h_usd, mcap_tvl_ratio, enriched_at FROM g_protocols
  ORDER BY tvl_usd DESC NULLS LAST, protocol_slug, name LIMIT 10""", "tvl_usd")
def _(v: Views):
    return serving.top_protocols(gold.gold_protocols(v.enriched))


_MACRO = """SELECT series_name, latest_date AS observation_date, current_value AS value,
  regime_label, change_30d_pct FROM g_macro ORDER BY latest_date DESC, series_name LIMIT 8"""


@query("macro_latest", _MACRO, "value change_30d_pct")
def _(v: Views):
    return serving.macro_latest(gold.gold_macro_regime(v.macro))


@query("watermark", "SELECT max(observed_at) AS watermark FROM g_rankings")
def _(v: Views):
    return serving.watermark(v.gold["rankings"])


_ACTIVITY = """SELECT asset_id, dev_activity_score, commits_30d, stars, contributors_count
  FROM g_enriched ORDER BY dev_activity_score DESC NULLS LAST, asset_id LIMIT 20"""


@query("top_activity", _ACTIVITY)
def _(v: Views):
    return serving.top_activity(gold.gold_enriched(v.enriched))


@query("recent_usage", f"SELECT {', '.join(serving.RECENT_USAGE)} FROM usage "
       "ORDER BY event_time DESC, request_id LIMIT 200", "cost_estimate")
def _(v: Views):
    return serving.recent_usage(v.role("usage"))


@query("audit_trail", f"SELECT {', '.join(serving.AUDIT_TRAIL)} FROM usage "
       "ORDER BY event_time DESC, request_id LIMIT 100", "cost_estimate")
def _(v: Views):
    return serving.audit_trail(v.role("usage"))


@query("recent_runs", f"SELECT {', '.join(serving.RECENT_RUNS)} FROM runs "
       "ORDER BY ingested_at DESC, job_name, run_id LIMIT 50")
def _(v: Views):
    return serving.recent_runs(v.role("runs"))


@query("cost_by_tier", "SELECT * FROM tiers", "total_cost_usd avg_latency_ms")
def _(v: Views):
    return serving.cost_by_tier(v.role("usage"))


@query("cost_by_tier_last_day", f"""SELECT model_tier, count(*) AS requests,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(cost_estimate) AS total_cost_usd,
  avg(latency_ms) AS avg_latency_ms, max(event_time) AS latest_request FROM usage
  WHERE event_time >= {_LAST_DAY} GROUP BY model_tier""", "total_cost_usd avg_latency_ms")
def _(v: Views):
    return serving.cost_by_tier(v.role("usage"), AS_OF, 24)


_DAILY = f"""SELECT CAST(CAST(event_time AS DATE) AS STRING) AS day, model_tier,
  sum(cost_estimate) AS cost_usd, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage
  WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1, 2"""


@query("daily_spend", _DAILY, "cost_usd")
def _(v: Views):
    return serving.daily_spend(v.role("usage"), AS_OF)


@query("cost_by_tenant", """SELECT tenant_id, model_tier, count(*) AS requests,
  sum(cost_estimate) AS total_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
  FROM usage GROUP BY 1, 2 ORDER BY total_cost_usd DESC LIMIT 20""", "total_cost_usd")
def _(v: Views):
    return serving.cost_by_tenant(v.role("usage"))


@query("recent_trend", f"SELECT * FROM trend WHERE hour_bucket >= TIMESTAMP '{AS_OF}' "
       "- INTERVAL 72 HOUR", "avg_latency_ms total_cost_estimate")
def _(v: Views):
    return serving.recent_trend(ops.cost_latency_trend(v.release), AS_OF)


@query("readiness_surfaces", f"""
  SELECT 'overview' AS surface, count(*) AS n FROM overview
  UNION ALL SELECT 'routes', count(*) FROM routes UNION ALL SELECT 'backlog', count(*) FROM backlog
  UNION ALL SELECT 'runs', count(*) FROM runs_r UNION ALL SELECT 'alerts', count(*) FROM alerts_r""")
def _(v: Views):
    release = v.release
    surfaces = serving.readiness_surfaces(
        ops.ready_overview(release), ops.route_latest(release), ops.alert_backlog(v.queue),
        ops.run_status(v.run_readiness), ops.alert_status(v.alert_readiness))
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("surface"), "n")
                      for name, df in surfaces.items()])


_SEVERITY = """CASE WHEN kind IN ('bundle_failure', 'bundle_cancelled') THEN 'high'
  WHEN kind IN ('error_spike', 'latency_breach', 'cost_anomaly', 'model_drift', 'retrain_trigger')
  THEN 'medium' ELSE 'low' END"""


@query("alerts_with_severity", f"""SELECT created_at AS alert_time, kind, {_SEVERITY} AS severity,
  route_selected, message, tenant_id, request_id FROM alerts
  ORDER BY created_at DESC, kind, request_id LIMIT 100""")
def _(v: Views):
    return serving.alerts_with_severity(v.role("alerts"))


@query("severity_counts", f"""SELECT {_SEVERITY} AS severity, count(*) AS count FROM alerts
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""")
def _(v: Views):
    return serving.severity_counts(v.role("alerts"), AS_OF)


_TOTALS = f"""SELECT job_name, max(ingested_at) AS last_run, count(*) AS total_runs,
  {n("status = 'SUCCESS'")} AS success_count, {n("status <> 'SUCCESS'")} AS failure_count
  FROM runs GROUP BY job_name"""


@query("job_totals", _TOTALS)
def _(v: Views):
    return serving.job_totals(v.role("runs"))


@query("context_json", f"""SELECT to_json(list({{asset_id: asset_id, stars: stars}}
  ORDER BY dev_activity_score DESC NULLS LAST, asset_id)) AS context
  FROM ({_ACTIVITY.replace('LIMIT 20', 'LIMIT 10')})""")
def _(v: Views):
    activity = gold.gold_enriched(v.enriched).na.fill(0, ["stars"])
    rows = activity.filter("repo_full_name IS NOT NULL OR asset_id IS NOT NULL")
    return serving.context_json(rows, [F.col("dev_activity_score").desc_nulls_last(),
                                       F.col("asset_id").asc()], ["asset_id", "stars"], 10)


# Dashboards ----------------------------------------------------------------------------------------------

@query("market_overview", f"""
  WITH r AS ({_T_RANKINGS}), m AS ({_T_MOVERS}), d AS ({_T_DOMINANCE}), c AS ({_T_COMPARISON})
  SELECT (SELECT count(*) FROM r) AS tracked_assets,
    CAST(least(3, (SELECT count(*) FROM m)) AS INT) AS top_movers_visible,
    CAST(least(4, (SELECT count(*) FROM d)) AS INT) AS dominance_groups_visible,
    greatest((SELECT max(observed_at) FROM r), (SELECT max(observed_at) FROM m),
      (SELECT max(observed_at) FROM d), (SELECT max(observed_at) FROM c)) AS watermark,
    'ready' AS freshness, '' AS warnings,
    (SELECT string_agg(upper(symbol), ',' ORDER BY market_cap_rank, observed_at DESC, asset_id)
     FROM (SELECT * FROM r ORDER BY market_cap_rank, observed_at DESC, asset_id LIMIT 5)) AS leaders,
    (SELECT string_agg(dominance_group, ',' ORDER BY dominance_pct DESC, dominance_group)
     FROM (SELECT * FROM d ORDER BY dominance_pct DESC, dominance_group LIMIT 4)) AS shares""")
def _(v: Views):
    page = metrics.market_overview(v.gold)
    leaders = F.from_json(F.get_json_object("sections", "$.market_rankings"),
                          "array<struct<asset:string>>")
    shares = F.from_json(F.get_json_object("sections", "$.dominance"),
                         "array<struct<group:string>>")
    return page.select("tracked_assets", "top_movers_visible", "dominance_groups_visible",
                       "watermark", "freshness", "warnings",
                       F.array_join(leaders["asset"], ",").alias("leaders"),
                       F.array_join(shares["group"], ",").alias("shares"))


@query("tenant_activity", "SELECT tenant_id, count(*) AS requests, max(event_time) AS last_seen "
       "FROM usage GROUP BY tenant_id")
def _(v: Views):
    return metrics.tenant_activity(v.role("usage"))


@query("tenant_activity_recent", """SELECT tenant_id, count(*) AS requests,
  max(event_time) AS last_seen FROM (SELECT * FROM usage ORDER BY event_time DESC, request_id
  LIMIT 500) GROUP BY tenant_id""")
def _(v: Views):
    return metrics.tenant_activity(v.role("usage"), 500)


@query("latency_quartiles", """SELECT model_tier, min(latency_ms) AS low,
  quantile_cont(latency_ms, 0.25) AS q1, quantile_cont(latency_ms, 0.5) AS median,
  quantile_cont(latency_ms, 0.75) AS q3, max(latency_ms) AS high FROM usage
  WHERE latency_ms IS NOT NULL GROUP BY model_tier""", "q1 median q3")
def _(v: Views):
    return metrics.latency_quartiles(v.role("usage"))


@query("status_distribution", """SELECT response_status, count(*) AS requests,
  count(*) / (SELECT count(*) FROM usage) * 100 AS share_pct FROM usage GROUP BY 1""", "share_pct")
def _(v: Views):
    return metrics.status_distribution(v.role("usage"))


_BADGE = """CASE WHEN kind LIKE '%error%' THEN 'critical' WHEN kind LIKE '%latency%'
  OR kind LIKE '%cost%' THEN 'warning' ELSE 'info' END"""


@query("alert_trend", f"""SELECT CAST(CAST(created_at AS DATE) AS STRING) AS day,
  count(*) FILTER (b = 'critical') AS critical, count(*) FILTER (b = 'warning') AS warning,
  count(*) FILTER (b = 'info') AS info FROM (SELECT created_at, {_BADGE} AS b FROM alerts)
  GROUP BY 1""")
def _(v: Views):
    return metrics.alert_trend(v.role("alerts"))


@query("alert_badges", f"""SELECT CAST(sum(CASE WHEN b = 'critical' THEN c ELSE 0 END) AS BIGINT) AS critical,
  CAST(sum(CASE WHEN b = 'warning' THEN c ELSE 0 END) AS BIGINT) AS warning,
  CAST(sum(CASE WHEN b = 'info' THEN c ELSE 0 END) AS BIGINT) AS info
  FROM (SELECT {_BADGE} AS b, count(*) AS c FROM alerts GROUP BY kind)""")
def _(v: Views):
    counted = v.role("alerts").groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
    return metrics.alert_badges(counted)


# Every route and job found in the tables, and the three resources judged as a whole.
_RESOURCES = """SELECT row_number() OVER (ORDER BY evidence, key) AS position, 'layer of ' || evidence AS layer,
    coalesce(key, evidence) AS resource, evidence, key
  FROM (SELECT 'job' AS evidence, job_name AS key FROM runs_r UNION ALL SELECT 'job', 'absent_job'
    UNION ALL SELECT 'route', route_selected FROM routes UNION ALL SELECT 'route', 'absent_route'
    UNION ALL SELECT unnest(['gold', 'jobs', 'alerts']), NULL)"""
_RESOURCE_HEALTH = f"""SELECT position, layer, resource, CASE evidence
    WHEN 'gold' THEN CASE WHEN o.stale_freshness_count = 0 THEN 'healthy' ELSE 'warning' END
    WHEN 'jobs' THEN CASE WHEN (SELECT bool_and(bundle_readiness_status = 'ready') FROM runs_r)
      THEN 'healthy' ELSE 'warning' END
    WHEN 'alerts' THEN CASE WHEN a.alert_status = 'ready' THEN 'healthy' ELSE 'critical' END
    WHEN 'job' THEN CASE WHEN j.job_name IS NULL THEN 'warning' WHEN j.failed_count > 0
      OR j.bundle_readiness_status <> 'ready' THEN 'critical' WHEN j.running_count > 0
      THEN 'warning' ELSE 'healthy' END
    ELSE CASE WHEN r.route_selected IS NULL THEN 'warning' WHEN r.readiness_status = 'ready'
      THEN 'healthy' WHEN r.error_count > 0 THEN 'critical' ELSE 'warning' END END AS status,
  CASE evidence WHEN 'gold' THEN 'stale=' || o.stale_freshness_count
    WHEN 'jobs' THEN 'jobs=' || (SELECT count(*) FROM runs_r)
    WHEN 'alerts' THEN 'runtime=' || a.runtime_alerts || ' bundle=' || a.bundle_alerts
    WHEN 'job' THEN 'ok=' || coalesce(j.success_count, 0) || ' fail=' || coalesce(j.failed_count, 0)
    ELSE CASE WHEN r.route_selected IS NULL THEN '' ELSE printf('lat=%dms cost=$%.4f ',
      CAST(floor(r.avg_latency_ms) AS BIGINT), r.total_cost_estimate) END || 'alerts=' || coalesce(b.w, 0)
    END AS metric
  FROM ({_RESOURCES}) x LEFT JOIN runs_r j ON x.evidence = 'job' AND j.job_name = x.key
  LEFT JOIN routes r ON x.evidence = 'route' AND r.route_selected = x.key
  LEFT JOIN (SELECT route_selected, sum(alert_count) AS w FROM backlog GROUP BY 1) b
    ON b.route_selected = x.key CROSS JOIN overview o CROSS JOIN alerts_r a"""


def _resource_table(v: Views):
    named = lambda df, name, kind: df.select(F.lit(kind).alias("evidence"), F.col(name).alias("key"))
    rest = v.spark.createDataFrame([("job", "absent_job"), ("route", "absent_route"), ("gold", None), ("jobs", None),
                                    ("alerts", None)], "evidence string, key string")
    rows = (named(v.run_readiness, "job_name", "job").unionByName(named(ops.route_latest(v.release), "route_selected", "route"))
            .unionByName(rest))
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("evidence", F.col("key").asc_nulls_last()))
    return rows.select(position.alias("position"), F.concat(F.lit("layer of "), "evidence").alias("layer"),
                       F.coalesce("key", "evidence").alias("resource"), "evidence", "key")


def _resources(v: Views):
    release = v.release
    return metrics.resource_health(
        ops.ready_overview(release), ops.route_latest(release), v.run_readiness,
        v.alert_readiness, ops.alert_backlog(v.queue), _resource_table(v))


@query("resource_health", _RESOURCE_HEALTH)
def _(v: Views):
    return _resources(v)


@query("health_kpis", f"""SELECT count(*) FILTER (status = 'healthy') AS healthy,
  count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'critical') AS critical,
  (SELECT total_cost_estimate FROM overview) + (SELECT sum(total_cost_usd) FROM tiers) AS total_cost
  FROM ({_RESOURCE_HEALTH})""", "total_cost")
def _(v: Views):
    return metrics.health_kpis(_resources(v), ops.ready_overview(v.release),
                               serving.cost_by_tier(v.role("usage")))


_NEAR = "policy_max_cost_estimate > 0 AND total_cost_estimate >= policy_max_cost_estimate * 0.8::DOUBLE"


def _items(rows: str, clear: str, impact: str) -> str:
    return f"""WITH f AS ({rows}) SELECT * FROM (SELECT * FROM f UNION ALL
      SELECT 99, '', '{clear}', '{impact}', NULL WHERE NOT EXISTS (SELECT 1 FROM f))
      ORDER BY priority, subject, rule"""


@query("optimization_items", _items(f"""
  SELECT 1 AS priority, route_selected AS subject, 'route_cost_near_limit' AS rule,
    'high' AS impact, total_cost_estimate AS value FROM routes
    WHERE route_selected = 'copilot' AND {_NEAR}
  UNION ALL SELECT 2, route_selected, 'long_prompts', 'medium', total_tokens FROM routes
    WHERE route_selected = 'copilot' AND total_tokens >= 3000
  UNION ALL SELECT 3, route_selected, 'stale_reads', 'high', stale_freshness_count FROM routes
    WHERE route_selected = 'genie' AND stale_freshness_count > 0
  UNION ALL SELECT 4, 'jobs', 'failed_jobs', 'high', n FROM
    (SELECT count(*) AS n FROM runs_r WHERE failed_count > 0) WHERE n > 0
  UNION ALL SELECT 5, 'alerts', 'runtime_backlog', 'medium', runtime_alerts FROM alerts_r
    WHERE runtime_alerts > 0
  UNION ALL SELECT 6, 'routes', 'costly_hours', 'medium', n FROM (SELECT count(*) AS n FROM trend
    WHERE total_cost_estimate >= 0.03) WHERE n > 0""", "all_clear", "low"), "value")
def _(v: Views):
    release = v.release
    return metrics.optimization_items(ops.route_latest(release), v.run_readiness,
                                      ops.cost_latency_trend(release), v.alert_readiness)


@query("cost_items", _items(f"""
  SELECT 1 AS priority, route_selected AS subject, 'cost_near_limit' AS rule,
    'warning' AS impact, total_cost_estimate AS value FROM routes WHERE {_NEAR}
  UNION ALL SELECT 1, route_selected, 'slow_route', 'danger', floor(avg_latency_ms) FROM routes
    WHERE floor(avg_latency_ms) >= 1000
  UNION ALL SELECT 2, 'jobs', 'failed_jobs', 'danger', n FROM
    (SELECT count(*) AS n FROM runs_r WHERE failed_count > 0) WHERE n > 0""",
    "all_clear", "success"), "value")
def _(v: Views):
    return metrics.cost_items(ops.route_latest(v.release), v.run_readiness)


@query("infra_rows", """
  SELECT x.position, x.resource, coalesce(total_cost_estimate, 0) AS cost,
    CAST(floor(coalesce(avg_latency_ms, 0)) AS BIGINT) AS latency,
    coalesce(readiness_status, 'hold') AS status
  FROM (VALUES (1, 'genie'), (2, 'copilot'), (3, 'dashboard_api')) AS x(position, resource)
  LEFT JOIN routes r ON r.route_selected = x.resource
  UNION ALL SELECT 4, 'jobs', 0.0, CAST(floor(max(avg_duration_ms)) AS BIGINT),
    CASE WHEN bool_and(bundle_readiness_status = 'ready') THEN 'ready' ELSE 'hold' END
  FROM runs_r""", "cost")
def _(v: Views):
    return metrics.infra_rows(ops.route_latest(v.release), v.run_readiness,
                              ["genie", "copilot", "dashboard_api"])


@query("spend_kpis", """SELECT sum(total_cost_usd) AS total_cost_usd,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(requests) AS BIGINT) AS requests,
  sum(total_cost_usd) / greatest(sum(requests), 1) AS cost_per_request FROM tiers""",
       "total_cost_usd cost_per_request")
def _(v: Views):
    return metrics.spend_kpis(serving.cost_by_tier(v.role("usage")))


@query("daily_tier_matrix", f"""SELECT day, coalesce(sum(cost_usd) FILTER (t = 'light'), 0) AS light,
  coalesce(sum(cost_usd) FILTER (t = 'standard'), 0) AS standard,
  coalesce(sum(cost_usd) FILTER (t = 'complex'), 0) AS complex,
  coalesce(sum(cost_usd) FILTER (t NOT IN ('light', 'standard', 'complex')), 0) AS other
  FROM (SELECT *, coalesce(model_tier, 'standard') AS t FROM ({_DAILY})) GROUP BY day""",
       "light standard complex other")
def _(v: Views):
    return metrics.daily_tier_matrix(serving.daily_spend(v.role("usage"), AS_OF))


@query("market_regime", """
  SELECT *, CASE WHEN rate IS NULL OR cpi IS NULL OR money IS NULL THEN 'unknown'
    WHEN rate <= 4 AND cpi <= 3 AND money >= 3 THEN 'risk_on'
    WHEN rate >= 4.5 OR cpi >= 3.5 THEN 'defensive' ELSE 'neutral' END AS regime
  FROM (SELECT max(value) FILTER (series_name = 'Fed Funds Rate') AS rate,
    max(value) FILTER (series_name = 'CPI YoY') AS cpi,
    max(value) FILTER (series_name = 'M2 Growth') AS money FROM macro_latest_rows)""",
       "rate cpi money")
def _(v: Views):
    latest = serving.macro_latest(gold.gold_macro_regime(v.macro), limit=None)
    return metrics.market_regime(latest)


@query("watchlist", """
  SELECT (SELECT symbol FROM g_rankings ORDER BY market_cap_rank, symbol LIMIT 1) AS cap_leader,
    b.symbol AS best_symbol, b.p AS best_change, w.symbol AS worst_symbol, w.p AS worst_change
  FROM (SELECT symbol, price_change_pct_24h AS p FROM g_movers WHERE price_change_pct_24h > 0
        ORDER BY p DESC, symbol LIMIT 1) b,
       (SELECT symbol, price_change_pct_24h AS p FROM g_movers WHERE price_change_pct_24h < 0
        ORDER BY p, symbol LIMIT 1) w""", "best_change worst_change")
def _(v: Views):
    return metrics.watchlist(v.gold["rankings"], v.gold["movers"])


@query("series_arrays", f"""SELECT series_name,
  string_agg(observation_date, '|' ORDER BY observation_date DESC) AS dates,
  string_agg(printf('%.3f', value), '|' ORDER BY observation_date DESC) AS points
  FROM ({_MACRO.replace('LIMIT 8', '')}) GROUP BY series_name""")
def _(v: Views):
    rows = metrics.series_arrays(serving.macro_latest(gold.gold_macro_regime(v.macro), limit=None))
    points = F.transform("values", lambda x: F.format_string("%.3f", x.cast("double")))
    return rows.select("series_name", "dates", F.array_join(points, "|").alias("points"))


@query("rank_series", """SELECT symbol AS label, market_cap_usd / 1e9 * 1e9 AS market_cap,
  CASE WHEN price_change_pct_24h > 0 THEN 'up' ELSE 'down' END AS sign FROM g_comparison""",
       "market_cap")
def _(v: Views):
    rows = metrics.rank_series(v.gold["comparison"])
    return rows.select("label", (F.col("market_cap_billion") * F.lit(1e9)).alias("market_cap"), "sign")


@query("assurance", f"""
  SELECT CAST(round_even((SELECT count(*) FILTER (status = 'pass') / count(*) * 100
      FROM ({_ALL_CHECKS})), 0) AS INT) AS confidence_pct,
    (SELECT count(*) FROM alerts WHERE kind IN ('bundle_failure', 'bundle_cancelled', 'error_spike'))
    + (SELECT count(*) FROM runs WHERE status <> 'SUCCESS') AS active_bugs""")
def _(v: Views):
    usage, runs = v.role("usage"), v.role("runs")
    checks = alerts.readiness_checks(usage, readers.route_policy(v.spark), runs)
    return metrics.assurance(checks, usage, runs, v.role("alerts"))


@query("success_series", f"""SELECT replace(replace(job_name, '_job', ''), '_ingestion', '') AS job,
  success_count, failure_count FROM ({_TOTALS})""")
def _(v: Views):
    return metrics.success_series(serving.job_totals(v.role("runs")))
