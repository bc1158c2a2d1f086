"""The test tables in the roles of the engine's inputs.

A role is a projection whose expressions mean the same in Spark SQL and in the checking database,
so both sides start from the same rows. All rows of a table take part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.readers import read_table

AS_OF = "2024-01-31 00:00:00"       # end of the events
ORDERS_AS_OF = "2001-08-01 00:00:00"  # last order date


class Role(NamedTuple):
    table: str
    columns: dict[str, str]
    prepare: tuple[str, ...] = ("*",)


_K = ("*", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k")
_TS = "CAST(ts AS TIMESTAMP)"
_ROUTE = ("CASE event_type WHEN 'click' THEN 'genie' WHEN 'view' THEN 'copilot' "
          "WHEN 'purchase' THEN 'dashboard_api' WHEN 'signup' THEN 'internal_app' "
          "ELSE 'copilot' END")
_JOB = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'market_ingestion_job' "
        "WHEN '2-HIGH' THEN 'protocol_ingestion_job' WHEN '3-MEDIUM' THEN 'silver_refresh_job' "
        "WHEN '4-NOT SPECIFIED' THEN 'feature_job' ELSE 'scoring_job' END")
_ORDER_TS = "CAST(o_orderdate AS TIMESTAMP)"

ROLES = {
    "bronze": Role("events", {
        "source_system": "CASE WHEN k < 60 THEN 'coingecko_api' WHEN k < 90 THEN 'partner_feed' "
                         "ELSE 'internal_reference' END",
        "source_record_id": "CAST(event_id AS STRING)",
        "asset_id": "'asset-' || CAST(user_id AS STRING)",
        "symbol": "CASE event_type WHEN 'click' THEN 'btc' WHEN 'view' THEN 'eth' "
                  "WHEN 'purchase' THEN 'usdt' WHEN 'signup' THEN 'sol' ELSE 'ada' END",
        "name": "CASE WHEN event_type = 'view' THEN NULL "
                "ELSE 'Asset ' || CAST(user_id AS STRING) END",
        "category": "CASE WHEN k < 20 THEN NULL ELSE event_type END",
        "observed_at": f"date_trunc('hour', {_TS})",
        "ingested_at": _TS,
        "market_cap_usd": "round((value - 2) * (k + 1), 2)",
        "price_usd": "value",
        "volume_24h_usd": "CAST(k * 100 AS DOUBLE)",
        "circulating_supply": "CAST(k + 1 AS DOUBLE)",
        "market_cap_rank": "nullif(k, 0)",
        "payload_version": "'v1'",
    }, _K),
    "market_feed": Role("events", {
        "asset_id": "CASE WHEN k < 50 THEN 'asset-' || CAST(user_id AS STRING) ELSE '' END",
        "id": "CASE WHEN k < 95 THEN 'id-' || CAST(user_id AS STRING) END",
        "symbol": "CASE WHEN k = 40 THEN '' ELSE event_type END",
        "name": "CASE WHEN k < 70 THEN 'Asset' ELSE '' END",
        "category": "CASE WHEN k < 70 THEN NULL ELSE event_type END",
        "observed_at": "CASE WHEN k < 90 THEN '2024-01-05 10:00:00' END",
        "last_updated": "'2024-01-06 11:00:00'",
        "ingested_at": "'2024-01-07 00:00:00'",
        "market_cap_usd": "CASE WHEN k < 80 THEN CAST(k AS STRING) END",
        "market_cap": "CASE WHEN k = 85 THEN 'n/a' ELSE CAST(k + 1 AS STRING) END",
        "price_usd": "CAST(NULL AS STRING)",
        "current_price": "CAST(event_id AS STRING)",
        "volume_24h_usd": "CASE WHEN k = 20 THEN '' ELSE '5' END",
        "total_volume": "'7'",
        "circulating_supply": "'9'",
        "market_cap_rank": "CASE WHEN k = 30 THEN 'x' ELSE CAST(k AS STRING) END",
        "source_system": "CASE WHEN k = 60 THEN 'unsupported' ELSE NULL END",
        "source_record_id": "CAST(NULL AS STRING)",
        "payload_version": "CAST(NULL AS STRING)",
    }, _K),
    "usage": Role("events", {
        "event_time": _TS,
        "request_id": "'req-' || CAST(event_id AS STRING)",
        "tenant_id": "'tenant-' || event_type",
        "user_id": "'user-' || CAST(user_id AS STRING)",
        "route_selected": _ROUTE,
        "model_or_engine": "'engine-' || event_type",
        "model_tier": "CASE event_type WHEN 'click' THEN 'light' WHEN 'view' THEN 'standard' "
                      "WHEN 'purchase' THEN 'complex' WHEN 'signup' THEN 'light' END",
        "prompt_tokens": "CAST(k * 10 AS INT)",
        "completion_tokens": "CAST(k * 5 AS INT)",
        "total_tokens": "CAST(nullif(k, 7) * 50 AS INT)",
        "latency_ms": "CAST(round(value * 40, 0) AS INT)",
        "cost_estimate": "CAST(nullif(k, 13) AS DOUBLE) * CAST(0.00137 AS DOUBLE)",
        "freshness_watermark": "CASE k WHEN 3 THEN NULL WHEN 5 THEN '' WHEN 11 THEN 'unknown' "
                               "WHEN 17 THEN 'pending' ELSE '2024-01-01' END",
        "response_status": "CASE WHEN k < 70 THEN 'success' WHEN k < 80 THEN 'partial' "
                           "WHEN k < 90 THEN 'refused' ELSE 'error' END",
    }, _K),
    "usage_feed": Role("events", {
        "event_time": "CAST(ts AS STRING)",
        "request_id": "CASE WHEN k = 1 THEN '' ELSE 'req-' || CAST(event_id AS STRING) END",
        "tenant_id": "CASE WHEN k = 2 THEN NULL ELSE 'tenant' END",
        "user_id": "CAST(NULL AS STRING)",
        "route_selected": "CASE WHEN k = 4 THEN 'dashboard.market-overview' "
                          "WHEN k = 6 THEN 'elsewhere' ELSE 'genie' END",
        "model_or_engine": "event_type",
        "model_tier": "CAST(NULL AS STRING)",
        "prompt_tokens": "CASE WHEN k = 8 THEN 'many' ELSE '' END",
        "completion_tokens": "CAST(NULL AS STRING)",
        "total_tokens": "CAST(CASE WHEN k = 12 THEN -5 ELSE k END AS STRING)",
        "latency_ms": "CASE WHEN k = 9 THEN 'slow' ELSE CAST(k AS STRING) END",
        "cost_estimate": "'0.5'",
        "freshness_watermark": "'2024'",
        "response_status": "CASE WHEN k = 10 THEN 'ok' ELSE 'success' END",
    }, _K),
    "runs": Role("orders", {
        "job_name": _JOB,
        "run_id": "'run-' || CAST(o_orderkey AS STRING)",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' "
                  "ELSE CASE WHEN o_totalprice < 100000 THEN 'CANCELLED' ELSE 'FAILED' END END",
        "result_state": "lower(o_orderstatus)",
        "update_time": _ORDER_TS,
        "duration_ms": "CASE WHEN o_totalprice > 450000 THEN NULL "
                       "ELSE CAST(floor(o_totalprice / 10) AS INT) END",
        "ingested_at": _ORDER_TS,
        "rows_written": "o_custkey",
        "error_message": "CASE WHEN o_orderstatus = 'P' THEN 'stopped' END",
    }),
    "run_feed": Role("orders", {
        "job_name": "CASE WHEN o_totalprice < 20000 THEN '' ELSE o_orderpriority END",
        "run_id": "CAST(o_orderkey AS STRING)",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' "
                  "ELSE CASE WHEN o_totalprice < 200000 THEN 'BROKEN' ELSE 'FAILED' END END",
        "result_state": "CAST(NULL AS STRING)",
        "update_time": "CAST(o_orderdate AS STRING)",
        "duration_ms": "CASE WHEN o_totalprice > 480000 THEN 'long' ELSE '10' END",
    }),
    "alerts": Role("events", {
        "kind": "CASE WHEN k < 10 THEN 'error_spike' WHEN k < 20 THEN 'latency_breach' "
                "WHEN k < 30 THEN 'cost_anomaly' WHEN k < 40 THEN 'freshness_gap' "
                "WHEN k < 50 THEN 'token_spike' WHEN k < 60 THEN 'bundle_failure' "
                "WHEN k < 70 THEN 'bundle_cancelled' WHEN k < 80 THEN 'model_drift' "
                "WHEN k < 90 THEN 'retrain_trigger' ELSE 'custom_notice' END",
        "message": "CASE WHEN k = 15 THEN '' ELSE 'event ' || event_type END",
        "request_id": "'req-' || CAST(event_id AS STRING)",
        "tenant_id": "'tenant-' || event_type",
        "route_selected": _ROUTE,
        "job_name": "CAST(NULL AS STRING)",
        "run_id": "CAST(NULL AS STRING)",
        "escalation": "CAST(NULL AS STRING)",
        "source": "CASE WHEN k = 25 THEN NULL ELSE 'test' END",
        "created_at": _TS,
    }, _K),
    "snapshots": Role("lineitem", {
        "asset_id": "'part-' || CAST(l_partkey AS STRING)",
        "source_record_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
        "symbol": "'P' || CAST(l_partkey AS STRING)",
        "name": "l_returnflag || l_linestatus",
        "market_cap_rank": "CAST(l_linenumber AS BIGINT)",
        "price_usd": "l_extendedprice",
        "market_cap_usd": "l_quantity",
        "volume_24h_usd": "l_tax",
        "source_system": "l_returnflag",
        "observed_at": "CAST(l_shipdate AS TIMESTAMP)",
        "ingested_at": "CAST(l_shipdate AS TIMESTAMP)",
    }),
    "protocols": Role("lineitem", {
        "source_record_id": "'PART-' || CAST(l_suppkey AS STRING)",
        "protocol_slug": "'proto-' || CAST(l_suppkey AS STRING)",
        "category": "l_returnflag",
        "tvl_usd": "l_extendedprice - 20000",
        "fees_24h_usd": "l_tax",
        "revenue_24h_usd": "l_discount",
        "mcap_tvl_ratio": "l_quantity",
        "observed_at": "CAST(l_shipdate AS TIMESTAMP)",
        "ingested_at": "CAST(l_shipdate AS TIMESTAMP)",
    }),
    "repos": Role("orders", {
        "asset_id": "'Part-' || CAST(o_custkey AS STRING)",
        "repo_full_name": "o_orderpriority || '/' || o_orderstatus",
        "stars": "CAST(floor(o_totalprice) AS BIGINT)",
        "forks": "o_orderkey",
        "open_issues": "CAST(1 AS BIGINT)",
        "contributors_count": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(2 AS BIGINT) END",
        "commits_30d": "CAST(floor(o_totalprice / 20000) AS BIGINT)",
        "commits_90d": "CAST(floor(o_totalprice / 5000) AS BIGINT)",
        "repo_age_days": "CAST(100 AS BIGINT)",
        "observed_at": _ORDER_TS,
        "ingested_at": _ORDER_TS,
    }),
    "macro": Role("orders", {
        "series_id": "CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' WHEN '2-HIGH' THEN 'M2SL' "
                     "WHEN '3-MEDIUM' THEN 'CPIAUCSL' WHEN '4-NOT SPECIFIED' THEN 'DTWEXBGS' "
                     "ELSE 'OTHER' END",
        "series_name": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Fed Funds Rate' "
                       "WHEN '2-HIGH' THEN 'M2 Growth' WHEN '3-MEDIUM' THEN 'CPI YoY' "
                       "WHEN '4-NOT SPECIFIED' THEN 'USD Index' ELSE 'Other' END",
        "observation_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
        "value": "o_totalprice / 100000",
        "source_record_id": "CAST(o_orderkey AS STRING)",
        "ingested_at": _ORDER_TS,
    }),
    "scores": Role("events", {
        "asset_id": "'asset-' || CAST(user_id AS STRING)",
        "symbol": "event_type",
        "scored_at": _TS,
        "predicted_regime": "CASE WHEN ts >= CAST('2024-01-30 00:00:00' AS TIMESTAMP) "
                            "AND value < 60 THEN 'risk_off' WHEN value < 20 THEN 'bull' "
                            "WHEN value < 40 THEN 'neutral' WHEN value < 150 THEN 'bear' "
                            "ELSE 'risk_off' END",
        "momentum_score": "value",
    }, _K),
    "requests": Role("conversations", {
        "request_id": "'req-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)",
        "tenant_id": "CASE WHEN turn = 6 THEN '' ELSE 'tenant-' || CAST(conv_id AS STRING) END",
        "session_id": "'conv-' || CAST(conv_id AS STRING)",
        "locale": "'en'",
        "channel": "CASE role WHEN 'user' THEN 'web_chat' WHEN 'assistant' THEN 'web_dashboard' "
                   "ELSE 'batch' END",
        "request_type_hint": "CASE turn WHEN 0 THEN 'auto' WHEN 1 THEN 'copilot' "
                             "WHEN 2 THEN 'analytics_nlq' WHEN 3 THEN 'dashboard_query' "
                             "WHEN 4 THEN 'auto' WHEN 5 THEN 'auto' ELSE 'other' END",
        "message_text": "text",
        "user_id": "CASE WHEN role = 'user' THEN 'user ' || CAST(conv_id AS STRING) END",
        "api_version": "CASE WHEN turn = 4 THEN 'v2' END",
        "selected_assets": "CASE WHEN turn = 2 THEN split('btc B!', ' ') "
                           "WHEN turn = 1 THEN split('btc eth-2', ' ') END",
        "asset_count": "CAST(turn AS INT)",
        "turns": "CAST(conv_id AS INT)",
    }),
}


def role(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spec = ROLES[name]
    return (read_table(spark, folder, spec.table).selectExpr(*spec.prepare)
            .selectExpr(*[f"{expr} AS {column}" for column, expr in spec.columns.items()]))


def role_sql(name: str) -> str:
    spec = ROLES[name]
    columns = ", ".join(f"{expr} AS {column}" for column, expr in spec.columns.items())
    return f"SELECT {columns} FROM (SELECT {', '.join(spec.prepare)} FROM {spec.table})"
