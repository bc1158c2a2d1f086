"""Declared schemas of feeds and tables. Feeds are read as text and cast, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 8)

_TYPES = {
    "string": T.StringType(), "ts": T.TimestampType(), "money": MONEY, "long": T.LongType(),
    "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(),
    "bool": T.BooleanType(),
}


def schema(**columns: str | T.DataType) -> T.StructType:
    """``name="type"`` pairs; a trailing ``*`` marks a required column."""
    fields = []
    for name, kind in columns.items():
        required = isinstance(kind, str) and kind.endswith("*")
        data_type = _TYPES[kind.rstrip("*")] if isinstance(kind, str) else kind
        fields.append(T.StructField(name, data_type, not required))
    return T.StructType(fields)


# Feeds -----------------------------------------------------------------------------------------
MARKET_FEED = schema(**{name: "string" for name in (
    "asset_id", "id", "symbol", "name", "category", "observed_at", "last_updated", "ingested_at",
    "market_cap_usd", "market_cap", "price_usd", "current_price", "volume_24h_usd",
    "total_volume", "circulating_supply", "market_cap_rank", "source_system",
    "source_record_id", "payload_version")})
PROTOCOL_FEED = schema(
    slug="string", name="string", chain="string", chains=T.ArrayType(T.StringType()),
    category="string", tvl="string", fees="string", feesHistory=T.ArrayType(T.StringType()),
    revenue="string", revenueHistory=T.ArrayType(T.StringType()), mcap="string",
    last_updated="string")
MACRO_FEED = schema(
    series_id="string",
    observations=T.ArrayType(schema(date="string", value="string")))
REPO_FEED = schema(
    asset_id="string", owner="string", repo="string", stargazers_count="long",
    forks_count="long", open_issues_count="long", pushed_at="string", created_at="string",
    weeks=T.ArrayType(schema(total="long")))
REPO_MAP = schema(asset_id="string", owner="string", repo="string")
USAGE_FEED = schema(**{name: "string" for name in (
    "event_time", "request_id", "tenant_id", "user_id", "route_selected", "model_or_engine",
    "model_tier", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms",
    "cost_estimate", "freshness_watermark", "response_status")})
RUN_FEED = schema(**{name: "string" for name in (
    "job_name", "run_id", "status", "result_state", "update_time", "duration_ms", "ingested_at",
    "rows_written", "error_message")})
ALERT_FEED = schema(**{name: "string" for name in (
    "kind", "message", "request_id", "tenant_id", "route_selected", "job_name", "run_id",
    "escalation", "source", "created_at")})
REQUEST_LOG = schema(
    tenant_id="string", session_id="string", request_id="string", locale="string",
    channel="string", request_type_hint="string", message_text="string", user_id="string",
    api_version="string", selected_assets=T.ArrayType(T.StringType()),
    time_range=T.MapType(T.StringType(), T.StringType()),
    ui_context=T.MapType(T.StringType(), T.StringType()))

# Bronze ----------------------------------------------------------------------------------------
BRONZE_MARKET = schema(
    source_system="string", source_record_id="string", asset_id="string", symbol="string",
    name="string", category="string", observed_at="ts", ingested_at="ts",
    market_cap_usd="money", price_usd="money", volume_24h_usd="money",
    circulating_supply="money", market_cap_rank="long", payload_version="string")
BRONZE_PROTOCOLS = schema(
    source_system="string*", source_record_id="string*", protocol_slug="string*",
    protocol_name="string*", chain="string", category="string", tvl_usd="money*",
    fees_24h_usd="money", revenue_24h_usd="money", mcap_tvl_ratio="money", observed_at="ts*",
    ingested_at="ts*", payload_version="string*")
BRONZE_REPOS = schema(
    source_system="string*", source_record_id="string*", asset_id="string*",
    repo_full_name="string*", stars="long", forks="long", open_issues="long",
    contributors_count="long", commits_30d="long", commits_90d="long", repo_age_days="long",
    last_push_at="string", observed_at="ts*", ingested_at="ts*", payload_version="string*")
BRONZE_MACRO = schema(
    source_system="string*", source_record_id="string*", series_id="string*",
    series_name="string*", observation_date="string*", value="money*", observed_at="ts*",
    ingested_at="ts*", payload_version="string*")

# Silver ----------------------------------------------------------------------------------------
SILVER_CHANGES = schema(
    asset_id="string", symbol="string", name="string", observed_at="ts", window_id="string",
    price_change_pct_1h="money", price_change_pct_24h="money", price_change_pct_7d="money",
    volume_24h_usd="money", market_cap_usd="money")
SILVER_DOMINANCE = schema(
    observed_at="ts", dominance_group="string", market_cap_usd="money", dominance_pct="money")
SILVER_COMPARISON = schema(
    asset_id="string", symbol="string", observed_at="ts", price_usd="money",
    market_cap_usd="money", volume_24h_usd="money", price_change_pct_24h="money",
    price_change_pct_7d="money", correlation_bucket="string")
SILVER_ENRICHED = schema(
    asset_id="string", symbol="string", name="string", market_cap_rank="long",
    price_usd="money", market_cap_usd="money", volume_24h_usd="money",
    snapshot_ingested_at="ts", protocol_slug="string", defi_category="string", tvl_usd="money",
    fees_24h_usd="money", revenue_24h_usd="money", mcap_tvl_ratio="money",
    repo_full_name="string", stars="long", forks="long", open_issues="long",
    contributors_count="long", commits_30d="long", commits_90d="long", repo_age_days="long",
    dev_activity_score="int", enriched_at="ts")
SILVER_MACRO = schema(
    series_id="string*", series_name="string*", latest_date="string*", current_value="money*",
    value_30d_ago="money", change_30d_pct="money", enriched_at="ts*")
SILVER_FEATURES = schema(
    asset_id="string", symbol="string", observed_at="ts", price_change_pct_24h="double",
    price_change_pct_7d="double", volume_24h_usd="double", market_cap_usd="double",
    vol_to_cap_ratio="double", dominance_pct_btc="double", momentum_score="double",
    feature_date="date")

# Gold and operations -----------------------------------------------------------------------------
GOLD_SCORES = schema(
    asset_id="string", symbol="string", scored_at="ts", predicted_regime="string",
    anomaly_score="int", momentum_score="double", regime_confidence="double",
    model_version="string")
LABEL_COUNTS = schema(scored_at="ts", predicted_regime="string", n="long")
USAGE_EVENTS = schema(
    event_time="ts", request_id="string", tenant_id="string", user_id="string",
    route_selected="string", model_or_engine="string", model_tier="string",
    prompt_tokens="int", completion_tokens="int", total_tokens="int", latency_ms="int",
    cost_estimate="double", freshness_watermark="string", response_status="string")
JOB_RUNS = schema(
    job_name="string", run_id="string", status="string", result_state="string",
    update_time="ts", duration_ms="int", ingested_at="ts", rows_written="long",
    error_message="string")
ALERTS = schema(
    kind="string", message="string", request_id="string", tenant_id="string",
    route_selected="string", job_name="string", run_id="string", escalation="string",
    source="string", created_at="ts")
ROUTE_POLICY = schema(
    route_selected="string", max_latency_ms="int", max_cost_estimate="double",
    max_total_tokens="int")
MODEL_RUNS = schema(
    model_name="string", version="long", trained_at="ts", cv_accuracy="double",
    path="string")
