"""Shape of physical plans: what reaches the scan, what is shuffled, what is joined how."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, asof, freshness, latest, percentiles, serving, silver
from tidemark.plans.layers import SERVING_ALIASES, build_layers, serving_views
from tidemark.session import cut_lineage
from tidemark.workload import storage
from tidemark.workload.registry import all_queries
from tidemark.workload.roles import AS_OF
from tidemark.workload.views import Views

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, FOLDER)


def test_latest_version_limits_groups_before_the_exchange(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_partkey", "l_shipdate")
    text = plan(latest.latest_version(df, ["l_partkey"], [F.col("l_shipdate").desc()]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert text.count("Exchange") == 1


def test_lookback_is_one_shuffle_without_joins(spark):
    df = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "user_id", "ts", "value")
    text = plan(asof.asof_lookback(df, "user_id", "ts", "value", {"a": (55, 65), "b": (1380, 1500)}))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert re.search(r"Exchange hashpartitioning\(_k0#\d+L?, _slice", text)


def test_features_are_not_shuffled_by_hour(spark, views):
    """Whichever side of the join is done first: only the plan's own broadcasts count here."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(views.features.select("*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [_hour" in text and "SortMergeJoin" not in text
    assert not re.search(r"Exchange hashpartitioning\(_hour", text)


def test_filters_and_columns_reach_the_scan(views):
    text = plan(serving.cost_by_tier(views.role("usage").filter("user_id IS NOT NULL"), "2024-01-31", 24))
    scan = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" in scan and "event_id" not in scan
    assert "PushedFilters: [IsNotNull(" in text or "PushedFilters: [" in text


def test_percentile_counts_values_before_any_window(spark):
    df = spark.read.parquet(f"{FOLDER}/events.parquet").select(F.col("value").cast("int").alias("v"))
    text = plan(percentiles.p95_floor(df, [], "v"))
    assert text.rindex("partial_count") > text.rindex("Window")


def test_alerts_scan_usage_and_runs_once(spark, tmp_path):
    """Both sides as tables of their own."""
    views = Views(spark, FOLDER)
    for name in ("usage", "runs"):
        views.role(name).write.parquet(f"{tmp_path}/{name}")
    usage, runs = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("usage", "runs"))
    found = alerts.evaluate_alerts(usage, runs, AS_OF, 24 * 40)
    assert found.count() >= 0
    found.collect()
    text = plan(found).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 2


def test_sort_and_limit_become_one_operator(views):
    text = plan(serving.recent_usage(views.role("usage")))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", sorted(set(all_queries()) - {
    "train_regime", "cv_gate", "feature_importance", "anomaly_scores", "score_assets",
    "stream_route_health", "register_layers", *storage.QUERIES}))
def test_joins_without_a_key_have_a_one_row_side(views, name):
    build, _ = all_queries()[name]
    df = build(views)
    assert "CartesianProduct" not in plan(df)
    open_nodes = [df._jdf.queryExecution().optimizedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and node.condition().isEmpty():
            bounds = [c.maxRows() for c in children]
            assert any(b.isDefined() and b.get() <= 1 for b in bounds), node.toString()[:2000]
        open_nodes += children


def test_group_sums_before_the_share_window(views):
    text = plan(silver.share_of_total(views.role("runs").withColumn("n", F.lit(1)), ["update_time"],
                                      F.col("job_name"), "job_name", "n", "pct"))
    assert text.index("Window") < text.index("HashAggregate")


def test_serving_in_one_pass_equals_the_join(views):
    one = freshness.serving_in_one_pass(freshness.gold_watches(*views.gold.values()),
                                        freshness.gold_quality_rules(*views.gold.values()), "2024-01-31")
    two = freshness.serving_readiness(
        freshness.quality_status(freshness.gold_quality_rules(*views.gold.values())),
        freshness.freshness_status(freshness.gold_watches(*views.gold.values()), "2024-01-31"))
    assert sorted(one.select(*two.columns).collect()) == sorted(two.collect())


def test_layers_build_in_order(views):
    tables = {"bronze_market_snapshots": views.role("bronze"), "bronze_protocols": views.role("protocols"),
              "bronze_repo_activity": views.role("repos"), "bronze_macro": views.role("macro"),
              "silver_asset_enriched": views.enriched, "silver_macro_context": views.macro,
              "ops_usage_events": views.role("usage"), "ops_bundle_runs": views.role("runs"),
              "ops_alerts": views.role("alerts")}
    layers = build_layers(tables, "2024-01-31")
    assert set(SERVING_ALIASES) <= set(layers) and len(layers) == 47
    names = list(layers)
    assert names.index("gold_top_movers") < names.index("mv_top_movers") < names.index("ops_release_readiness")
    assert set(serving_views(layers)) == set(SERVING_ALIASES)


def test_checkpoint_ends_the_lineage(spark):
    df = cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert "Range" not in plan(df) and df.count() == 10
