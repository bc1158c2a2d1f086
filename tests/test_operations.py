import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import access, alerts, drift, metrics, ops, percentiles, serving
from tidemark.sources.readers import route_policy
from tests.conftest import dicts

NOW = "2024-01-31 12:00:00"
USAGE = ("event_time timestamp, request_id string, tenant_id string, user_id string,"
         "route_selected string, model_or_engine string, model_tier string, total_tokens int,"
         "latency_ms int, cost_estimate double, freshness_watermark string, response_status string")
RUNS = ("job_name string, run_id string, status string, result_state string,"
        "update_time timestamp, duration_ms int, ingested_at timestamp")


def event(i=0, *, route="genie", tier="light", tokens=10, latency=100, cost=0.001, mark="now",
          status="success", time="2024-01-31 11:30:00"):
    return (time, f"r{i}", "t", "u", route, "m", tier, tokens, latency, cost, mark, status)


def run(job, status, i=0, time="2024-01-31 11:30:00"):
    return (job, f"x{i}", status, status, time, 1500, time)


def kinds(df):
    return sorted(r["kind"] for r in dicts(df))


def test_error_rate(frame):
    df = frame(USAGE, *[event(i, status="error" if i < 5 else "success") for i in range(10)])
    row = dicts(alerts.error_rate_alerts(df, NOW))[0]
    assert row["message"] == ("Error rate 50.0% exceeds threshold 10.0% (5/10 requests in window).")
    assert not dicts(alerts.error_rate_alerts(df, "2024-02-01 12:00:00"))


@pytest.mark.parametrize("n", [1, 2, 10, 20, 21, 100, 101])
def test_p95_floor_rank(spark, n):
    values = list(range(1, n + 1))
    random.Random(n).shuffle(values)
    df = spark.createDataFrame([(v * 1000,) for v in values], "v int")
    assert dicts(percentiles.p95_floor(df, [], "v"))[0]["p95_v"] == max(1, int(n * 0.95)) * 1000


def test_p95_floor_per_group_with_repeats(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([5, 70_000, rng.randint(0, 900_000)])) for g in "aab" for _ in range(301)]
    df = spark.createDataFrame(rows + [("c", None)], "g string, v int")
    got = {r["g"]: r["p95_v"] for r in dicts(percentiles.p95_floor(df, ["g"], "v"))}
    for g in "ab":
        mine = sorted(v for k, v in rows if k == g)
        assert got[g] == mine[max(0, int(len(mine) * 0.95) - 1)]
    assert "c" not in got


def test_cost_latency_and_tier_alerts(frame):
    df = frame(USAGE, *[event(i, cost=0.5, latency=6000, tier=None if i else "complex") for i in range(4)])
    assert dicts(alerts.cost_alerts(df, NOW))[0]["message"] == (
        "Hourly cost $2.0000 exceeds threshold $1.00.")
    assert dicts(alerts.latency_alerts(df, NOW))[0]["message"] == (
        "P95 latency 6000ms exceeds threshold 5000ms.")
    assert sorted(r["message"][:36] for r in dicts(alerts.tier_latency_alerts(df, NOW))) == [
        "P95 latency for tier 'complex' is 60", "P95 latency for tier 'standard' is 6"]


def test_run_alerts_and_all_together(frame):
    usage = frame(USAGE, *[event(i, cost=0.5) for i in range(4)])
    runs = frame(RUNS, run("a", "FAILED"), run("b", "CANCELLED", 1), run("c", "SUCCESS", 2))
    assert kinds(alerts.run_alerts(runs, NOW)) == ["bundle_cancelled", "bundle_failure"]
    found = dicts(alerts.evaluate_alerts(usage, runs, NOW))
    assert sorted((r["kind"], r["high_severity"]) for r in found) == [
        ("bundle_cancelled", True), ("bundle_failure", True), ("cost_anomaly", False)]
    assert kinds(alerts.evaluate_alerts(usage.limit(0), runs.limit(0), NOW)) == []


def test_one_event_can_raise_five_alerts_but_queues_once(frame):
    df = frame(USAGE, event(route="copilot", status="error", latency=1200, cost=0.08, mark=None,
                            tokens=4500))
    assert kinds(alerts.event_alerts(df)) == [
        "cost_anomaly", "error_spike", "freshness_gap", "latency_breach", "token_spike"]
    assert [r["alert_kind"] for r in dicts(ops.alert_queue(ops.usage_normalized(df)))] == ["error_spike"]
    assert dicts(alerts.usage_summary(df))[0]["alerts"] == 5


def test_run_summary_counts_cancelled_and_unknown_as_failures(frame):
    df = frame(RUNS, run("a", "success"), run("b", "canceled"), run("c", "odd"), run("d", "queued"))
    got = dicts(alerts.run_summary(df))[0]
    assert (got["runs"], got["successes"], got["failures"], got["running"], got["cancelled"]) == (4, 1, 2, 1, 1)


def test_readiness_of_a_clean_log(spark, frame):
    usage, runs = frame(USAGE, event()), frame(RUNS, run("a", "SUCCESS"))
    result = alerts.evaluate_readiness(usage, route_policy(spark), runs)
    assert dicts(result["ready"]) == [{"ready": True}]
    assert {r["status"] for r in dicts(result["checks"])} == {"pass"} and result["checks"].count() == 9


def test_readiness_without_telemetry(spark, frame):
    usage, runs = frame(USAGE), frame(RUNS, run("a", "SUCCESS"))
    blockers = alerts.readiness_blockers(usage, route_policy(spark), runs)
    assert [(r["kind"], r["escalation"]) for r in dicts(blockers)] == [("missing_telemetry", "block_release")]
    checks = alerts.readiness_checks(usage, route_policy(spark), runs)
    score = dicts(alerts.readiness_score(checks, blockers, runs))[0]
    assert score == {"score": 75, "blockers": 0, "ready": True, "operational_state": "monitoring_limited"}
    failed = frame(RUNS, run("a", "FAILED"))
    held = dicts(alerts.readiness_score(
        alerts.readiness_checks(usage, route_policy(spark), failed),
        alerts.readiness_blockers(usage, route_policy(spark), failed), failed))[0]
    assert not held["ready"] and held["blockers"] == 2


def test_policy_layers(spark, frame):
    usage = frame(USAGE, event(route="genie", latency=600), event(1, route="other", latency=600),
                  event(2, route="copilot", latency=600))
    override = frame("route_selected string, max_latency_ms int, max_cost_estimate double,"
                     "max_total_tokens int", ("copilot", 100, None, None))
    rows = dicts(alerts.threshold_checks(usage, route_policy(spark), override))
    latency = {r["route_selected"]: (r["status"], r["threshold"]) for r in rows if "latency" in r["name"]}
    assert latency == {"genie": ("fail", "500"), "other": ("pass", "1000"), "copilot": ("fail", "100")}


def test_route_health_and_release(spark, frame):
    usage = frame(USAGE, event(), event(1, status="error", time="2024-01-31 10:30:00"))
    serving_all = frame("serving_status string", ("serve",), ("serve",))
    release = ops.release_readiness(ops.route_health(ops.usage_normalized(usage)), route_policy(spark),
                                    serving_all)
    assert {str(r["hour_bucket"])[11:13]: r["readiness_status"] for r in dicts(release)} == {
        "11": "ready", "10": "hold"}
    held = ops.release_readiness(ops.route_health(ops.usage_normalized(usage)), route_policy(spark),
                                 serving_all.unionAll(frame("serving_status string", ("hold",))))
    assert {r["readiness_status"] for r in dicts(held)} == {"hold"}
    empty = dicts(ops.ready_overview(release.limit(0)))[0]
    assert empty["route_rows"] == 0 and empty["ready_routes"] is None


def test_empty_alert_log_is_on_hold(frame):
    empty = ops.alerts_normalized(frame("kind string, created_at timestamp"))
    assert dicts(ops.alert_readiness(empty))[0]["alert_status"] == "hold"
    other = ops.alerts_normalized(frame("kind string, created_at timestamp", ("model_drift", NOW)))
    assert dicts(ops.alert_readiness(other))[0]["alert_status"] == "ready"


def test_run_readiness(frame):
    runs = ops.runs_normalized(frame(RUNS, run("a", "FAILED", 1, "2024-01-01 00:00:00"),
                                     run("a", "SUCCESS", 2), run("b", "SUCCESS", 3)))
    rows = {r["job_name"]: r for r in dicts(ops.run_readiness(ops.run_health(runs), ops.run_latest(runs)))}
    assert rows["a"]["serving_status"] == "hold" and rows["a"]["latest_run_state"] == "success"
    assert rows["b"]["serving_status"] == "serve"


# Drift -------------------------------------------------------------------------------------------------

def test_psi(frame):
    shares = lambda *rows: frame("label string, share double", *rows)
    value = lambda a, b: dicts(drift.psi(a, b))[0]["psi"]
    same = shares(("x", 0.9), ("y", 0.1))
    assert value(same, same) == 0.0
    assert value(same, shares(("x", 0.1), ("y", 0.9))) > 0.2
    assert value(same, shares(("x", 0.1), ("z", 0.9))) == 8.329044
    assert value(same, shares()) == 0.0 and dicts(drift.label_distribution(
        frame("predicted_regime string, scored_at timestamp"))) == []


def test_drift_alert_and_retraining(frame):
    scores = frame("predicted_regime string, scored_at timestamp",
                   *[("bull", "2024-01-28 00:00:00")] * 9, ("bear", "2024-01-31 11:00:00"))
    assert kinds(drift.drift_alert(scores, NOW)) == ["model_drift"]
    log = frame("kind string, created_at timestamp", *[("model_drift", "2024-01-30 00:00:00")] * 3)
    assert kinds(drift.retrain_trigger(log, NOW)) == ["retrain_trigger"]
    assert kinds(drift.retrain_trigger(log.limit(2), NOW)) == []


# Serving and dashboards ----------------------------------------------------------------------------------

def test_top_at_latest_keeps_only_the_newest_time(frame):
    df = frame("ts timestamp, v int", (NOW, 1), (NOW, 5), ("2024-01-01 00:00:00", 9))
    assert [r["v"] for r in dicts(serving.top_at_latest(df, "ts", [F.desc("v")], 2))] == [5, 1]
    assert [r["v"] for r in dicts(serving.top_at_latest(df, "ts", [F.desc("v")], 10))] == [5, 1]


def test_context_json_is_ordered(frame):
    df = frame("k string, v int", ("a", 1), ("b", 3), ("c", 2))
    assert dicts(serving.context_json(df, [F.desc("v")], ["k"], 2))[0]["context"] == '[{"k":"b"},{"k":"c"}]'


def test_badges_and_trend(frame):
    df = frame("kind string, created_at timestamp", ("error_spike", NOW), ("cost_anomaly", NOW),
               ("freshness_gap", NOW), ("latency_breach", NOW))
    assert dicts(metrics.alert_badges(df)) == [{"critical": 1, "warning": 2, "info": 1}]
    assert [(r["critical"], r["warning"], r["info"]) for r in dicts(metrics.alert_trend(df))] == [(1, 2, 1)]


def test_market_regime_and_items(frame):
    macro = lambda *rows: dicts(metrics.market_regime(frame(
        "series_name string, observation_date string, value double", *rows)))[0]["regime"]
    full = lambda r, c, m: macro(("Fed Funds Rate", "d", r), ("CPI YoY", "d", c), ("M2 Growth", "d", m))
    assert [full(4.0, 3.0, 3.0), full(4.5, 3.0, 3.0), full(4.2, 3.2, 1.0), macro(("CPI YoY", "d", 1.0))] == [
        "risk_on", "defensive", "neutral", "unknown"]


def test_all_clear_item_when_nothing_is_found(frame):
    routes = frame("route_selected string, total_cost_estimate double, policy_max_cost_estimate double,"
                   "avg_latency_ms double", ("genie", 0.001, 0.02, 10.0))
    runs = frame("failed_count long", (0,))
    assert [r["rule"] for r in dicts(metrics.cost_items(routes, runs))] == ["all_clear"]
    costly = routes.withColumn("total_cost_estimate", F.lit(0.016)).withColumn(
        "avg_latency_ms", F.lit(1500.0))
    assert [r["rule"] for r in dicts(metrics.cost_items(costly, frame("failed_count long", (2,))))] == [
        "cost_near_limit", "slow_route", "failed_jobs"]


def test_assurance_falls_back_to_success_share(frame):
    checks = frame("name string, status string")
    usage = frame(USAGE, event(), event(1, status="error"), event(2))
    runs, log = frame(RUNS, run("a", "FAILED")), frame("kind string", ("error_spike",), ("cost_anomaly",))
    assert dicts(metrics.assurance(checks, usage, runs, log)) == [{"confidence_pct": 67, "active_bugs": 2}]


def test_row_filter_and_mask(frame):
    df = frame("user_id string, cost double", ("a", 1.0), ("b", 2.0))
    assert access.row_filter(df, "a", []).count() == 1
    assert access.row_filter(df, "a", [], None).count() == 0
    assert access.row_filter(df, "a", ["platform_ops"]).count() == 2
    assert [r["cost"] for r in dicts(access.mask(df, "cost", []))] == [None, None]
    assert [r["cost"] for r in dicts(access.mask(df, "cost", ["governance_admin"]))] == [1.0, 2.0]
