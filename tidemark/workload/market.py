"""Sources, validation, silver, enrichment and gold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import columns as C
from tidemark.functions import fixed_values as fv
from tidemark.operators import asof, enrich, freshness, gold, latest, silver, validate
from tidemark.sources import align, readers, writers
from tidemark.workload.roles import AS_OF
from tidemark.workload.views import Views, sql

QUERIES: dict = {}


def query(name: str, text: str | None = None, round6: str = ""):
    def register(build):
        QUERIES[name] = (build, sql(text, round6) if text else None)
        return build
    return register


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Versions and merges ----------------------------------------------------------------------------

@query("latest_version", """
  SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
    l_linenumber DESC, l_extendedprice DESC) = 1""")
def _(v: Views):
    rows = readers.read_table(v.spark, v.folder, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return latest.latest_version(rows, ["l_partkey"], [
        F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")])


@query("dedup_batch", """
  SELECT source_system, name, max(source_record_id) AS source_record_id FROM bronze
  GROUP BY source_system, name""")
def _(v: Views):
    rows = v.role("bronze").select("source_system", "name", "source_record_id")
    return latest.dedup_batch(rows, ["source_system", "name"], [F.col("source_record_id").desc()])


_HALVES = ("o_orderdate < TIMESTAMP '1999-01-01'", "o_orderdate >= TIMESTAMP '1998-06-01'")


@query("merge_insert_only", f"""
  WITH t AS (SELECT o_custkey AS k, max(o_orderdate) AS d, max(o_totalprice) AS p FROM orders
             WHERE {_HALVES[0]} GROUP BY 1),
       s AS (SELECT o_custkey AS k, o_orderdate AS d, o_totalprice AS p FROM orders
             WHERE {_HALVES[1]} QUALIFY row_number() OVER (PARTITION BY o_custkey
             ORDER BY o_orderdate DESC, o_totalprice DESC) = 1)
  SELECT * FROM t UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM t)""")
def _(v: Views):
    orders = readers.read_table(v.spark, v.folder, "orders")
    target = orders.filter(_HALVES[0]).groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_orderdate").alias("d"), F.max("o_totalprice").alias("p"))
    source = orders.filter(_HALVES[1]).select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"),
        F.col("o_totalprice").alias("p"))
    return writers.merge_insert_only(target, source, ["k"], [F.desc("d"), F.desc("p")])


@query("merge_upsert_newest", f"""
  WITH b AS (SELECT o_custkey AS k, o_orderdate AS d, o_totalprice AS p, 0 AS s FROM orders
             WHERE {_HALVES[0]} UNION ALL
             SELECT o_custkey, o_orderdate, o_totalprice, 1 FROM orders WHERE {_HALVES[1]})
  SELECT k, d, p FROM b QUALIFY row_number() OVER (PARTITION BY k
    ORDER BY d DESC, s DESC, p DESC) = 1""")
def _(v: Views):
    orders = readers.read_table(v.spark, v.folder, "orders")
    half = lambda condition: orders.filter(condition).select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"),
        F.col("o_totalprice").alias("p"))
    return writers.merge_upsert_newest(half(_HALVES[0]), half(_HALVES[1]), ["k"], "d")


@query("align_to_schema", """
  SELECT CAST(o_orderkey AS STRING) AS run_id, CAST(o_totalprice AS BIGINT) AS rows_written
  FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)""")
def _(v: Views):
    orders = readers.read_table(v.spark, v.folder, "orders")
    rows = orders.select(F.floor("o_totalprice").cast("double").alias("rows_written"),
                         F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    return align.align_to_schema(rows, schemas.JOB_RUNS)


@query("bronze_landing", """
  SELECT source_system, source_record_id, asset_id, upper(symbol) AS symbol, name, category,
    observed_at, ingested_at, market_cap_usd, price_usd, volume_24h_usd, circulating_supply,
    market_cap_rank, payload_version FROM bronze""")
def _(v: Views):
    return align.to_bronze_market(v.role("bronze"))


@query("route_policy", "SELECT route_selected, policy_max_latency_ms AS max_latency_ms, "
       "policy_max_cost_estimate AS max_cost_estimate, "
       "policy_max_total_tokens AS max_total_tokens, n AS events FROM policy JOIN "
       "(SELECT route_selected, count(*) AS n FROM usage GROUP BY 1) USING (route_selected)")
def _(v: Views):
    events = v.role("usage").groupBy("route_selected").agg(F.count(F.lit(1)).alias("events"))
    return readers.route_policy(v.spark).join(events, "route_selected")


# Validation ----------------------------------------------------------------------------------------

_FEED = """SELECT coalesce(nullif(source_system, ''), 'coingecko_api') AS source_system,
    coalesce(nullif(asset_id, ''), id) AS asset_id, upper(symbol) AS symbol,
    coalesce(nullif(name, ''), 'unmapped') AS name,
    coalesce(nullif(category, ''), 'unclassified') AS category,
    coalesce(observed_at, last_updated) AS observed_at, ingested_at,
    coalesce(market_cap_usd, market_cap) AS market_cap_usd,
    coalesce(price_usd, current_price) AS price_usd,
    coalesce(volume_24h_usd, total_volume) AS volume_24h_usd, circulating_supply, market_cap_rank,
    'coingecko_markets_v1' AS payload_version FROM market_feed"""
_FEED_ID = ("CASE WHEN asset_id IS NOT NULL THEN asset_id || ':' || observed_at END "
            "AS source_record_id")


@query("normalize_market", f"SELECT *, {_FEED_ID} FROM ({_FEED})")
def _(v: Views):
    return validate.normalize_market(v.role("market_feed"), C.moment(AS_OF))


@query("validate_market", f"""
  SELECT asset_id, observed_at, price_usd, concat_ws('|',
    CASE WHEN asset_id IS NULL THEN 'missing:source_record_id' END,
    CASE WHEN asset_id IS NULL THEN 'missing:asset_id' END,
    CASE WHEN symbol = '' THEN 'missing:symbol' END,
    CASE WHEN volume_24h_usd = '' THEN 'missing:volume_24h_usd' END,
    CASE WHEN source_system = 'unsupported' THEN 'unsupported:source_system' END,
    CASE WHEN market_cap_usd = 'n/a' THEN 'invalid:market_cap_usd' END,
    CASE WHEN market_cap_rank = 'x' THEN 'invalid:market_cap_rank' END) AS reasons
  FROM ({_FEED})""")
def _(v: Views):
    feed = validate.normalize_market(v.role("market_feed"), C.moment(AS_OF))
    return validate.validate_market(feed).checked.select(
        "asset_id", "observed_at", "price_usd", "reasons")


@query("normalize_protocols", """
  SELECT 'defillama' AS source_system, slug AS source_record_id, slug AS protocol_slug, p_name AS protocol_name,
    CASE WHEN p_size < 10 THEN 'unknown' WHEN p_size < 20 THEN p_type ELSE 'eth' END AS chain,
    coalesce(nullif(p_type, ''), 'unclassified') AS category, p_retailprice AS tvl_usd,
    CASE WHEN p_size = 0 THEN 9.5::DOUBLE ELSE p_size::DOUBLE END AS fees_24h_usd,
    CASE WHEN p_size > 30 THEN NULL ELSE 1.5::DOUBLE END AS revenue_24h_usd,
    round(p_size * 1000 / p_retailprice, 6) AS mcap_tvl_ratio,
    TIMESTAMP '2024-01-31' AS observed_at, TIMESTAMP '2024-01-31' AS ingested_at,
    'defillama_protocols_v1' AS payload_version
  FROM (SELECT *, CASE WHEN p_size < 25 THEN replace(lower(p_name), ' ', '-')
               ELSE 'slug-' || p_partkey END AS slug FROM part) WHERE p_size <> 40""")
def _(v: Views):
    part = readers.read_table(v.spark, v.folder, "part")
    text = lambda e: F.expr(e).cast("string")
    feed = part.select(
        text("CASE WHEN p_size >= 25 THEN 'slug-' || CAST(p_partkey AS STRING) END").alias("slug"),
        F.col("p_name").alias("name"),
        text("CASE WHEN p_size BETWEEN 10 AND 19 THEN p_type END").alias("chain"),
        F.expr("CASE WHEN p_size >= 20 THEN array('eth', 'base') "
               "ELSE CAST(array() AS array<string>) END").alias("chains"),
        F.col("p_type").alias("category"),
        text("CASE WHEN p_size = 40 THEN 'n/a' ELSE CAST(p_retailprice AS STRING) END").alias("tvl"),
        text("p_size").alias("fees"),
        F.array(F.lit("3"), F.lit("9.5")).alias("feesHistory"),
        text("NULL").alias("revenue"),
        F.expr("CASE WHEN p_size > 30 THEN CAST(array() AS array<string>) "
               "ELSE array('1.5') END").alias("revenueHistory"),
        text("nullif(p_size * 1000, 0)").alias("mcap"), text("NULL").alias("last_updated"))
    return validate.normalize_protocols(feed, C.moment(AS_OF))


@query("normalize_observations", """
  SELECT 'fred' AS source_system, series_id || ':' || d AS source_record_id, series_id,
    series_name, d AS observation_date, o_totalprice AS value,
    TIMESTAMP '2024-01-31' AS observed_at, TIMESTAMP '2024-01-31' AS ingested_at,
    'fred_observations_v1' AS payload_version
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' WHEN '2-HIGH' THEN 'M2SL'
      WHEN '3-MEDIUM' THEN 'CPIAUCSL' WHEN '4-NOT SPECIFIED' THEN 'DTWEXBGS' END AS series_id,
      CASE o_orderpriority WHEN '1-URGENT' THEN '10yr_treasury_yield'
      WHEN '2-HIGH' THEN 'm2_money_supply' WHEN '3-MEDIUM' THEN 'cpi_inflation'
      WHEN '4-NOT SPECIFIED' THEN 'usd_trade_index' END AS series_name,
      CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 50000)
  WHERE series_id IS NOT NULL""")
def _(v: Views):
    orders = readers.read_table(v.spark, v.folder, "orders")
    feed = orders.select(
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' WHEN '2-HIGH' THEN 'M2SL' "
               "WHEN '3-MEDIUM' THEN 'CPIAUCSL' WHEN '4-NOT SPECIFIED' THEN 'DTWEXBGS' "
               "ELSE 'OTHER' END").alias("series_id"),
        F.expr("array(named_struct('date', CASE WHEN o_totalprice < 50000 THEN '' "
               "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END, 'value', "
               "CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS STRING) "
               "WHEN 'O' THEN '.' ELSE 'n/a' END))").alias("observations"))
    return validate.normalize_observations(feed, readers.series_names(v.spark), C.moment(AS_OF))


# the weekly totals of a repository: the digits of an order's key, customer and price
_DIGITS = ("CAST(o_orderkey AS STRING) || CAST(o_custkey AS STRING) "
           "|| CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)")


@query("repo_activity", f"""
  WITH w AS (SELECT o_orderkey, list_transform(regexp_extract_all({_DIGITS}, '([0-9])', 1),
               lambda x: CAST(x AS BIGINT)) AS q FROM orders)
  SELECT 'github' AS source_system, CAST(o_orderkey AS STRING) AS source_record_id,
    CAST(o_orderkey AS STRING) AS asset_id, 'own/' || o_orderkey AS repo_full_name,
    5::BIGINT AS stars, 0::BIGINT AS forks, 2::BIGINT AS open_issues,
    CASE WHEN len(q) >= 4 THEN len(list_filter(q[greatest(len(q) - 12, 1):], lambda x: x > 0))
      ELSE 0 END::BIGINT AS contributors_count,
    CASE WHEN len(q) >= 4 THEN list_sum(q[len(q) - 3:]) ELSE 0 END::BIGINT AS commits_30d,
    CASE WHEN len(q) >= 4 THEN list_sum(q[greatest(len(q) - 12, 1):]) ELSE 0 END::BIGINT
      AS commits_90d,
    30::BIGINT AS repo_age_days, '' AS last_push_at, TIMESTAMP '2024-01-31' AS observed_at,
    TIMESTAMP '2024-01-31' AS ingested_at, 'github_activity_v1' AS payload_version FROM w""")
def _(v: Views):
    orders = readers.read_table(v.spark, v.folder, "orders")
    digits = F.regexp_extract_all(F.expr(_DIGITS), F.lit("([0-9])"), F.lit(1))
    key = F.col("o_orderkey").cast("string")
    feed = orders.select(
        key.alias("asset_id"), F.lit("own").alias("owner"), key.alias("repo"),
        F.lit(5).cast("bigint").alias("stargazers_count"),
        F.lit(None).cast("bigint").alias("forks_count"),
        F.lit(2).cast("bigint").alias("open_issues_count"),
        F.lit(None).cast("string").alias("pushed_at"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.transform(digits, lambda d: F.struct(d.cast("bigint").alias("total"))).alias("weeks"))
    now = C.moment(AS_OF)
    return validate.normalize_activity(validate.repo_activity(feed, now), now)


@query("validate_usage", """
  SELECT request_id, CASE WHEN route_selected = 'dashboard.market-overview'
      THEN 'dashboard_api' ELSE route_selected END AS route_selected, concat_ws('|',
    CASE WHEN request_id = '' THEN 'missing:request_id' END,
    CASE WHEN tenant_id IS NULL THEN 'missing:tenant_id' END,
    CASE WHEN route_selected = 'elsewhere' THEN 'unsupported:route_selected' END,
    CASE WHEN response_status = 'ok' THEN 'unsupported:response_status' END,
    CASE WHEN latency_ms = 'slow' THEN 'invalid:latency_ms' END,
    CASE WHEN prompt_tokens = 'many' THEN 'invalid:prompt_tokens' END) AS reasons
  FROM usage_feed""")
def _(v: Views):
    return validate.validate_usage(v.role("usage_feed")).checked.select(
        "request_id", "route_selected", "reasons")


@query("validate_runs", """
  SELECT run_id, concat_ws('|', CASE WHEN job_name = '' THEN 'missing:job_name' END,
    CASE WHEN status = 'BROKEN' THEN 'unsupported:status' END,
    CASE WHEN duration_ms = 'long' THEN 'invalid:duration_ms' END) AS reasons FROM run_feed""")
def _(v: Views):
    return validate.validate_runs(v.role("run_feed")).checked.select("run_id", "reasons")


@query("validate_alerts", """
  SELECT request_id, coalesce(nullif(source, ''), 'sentinela') AS source, concat_ws('|',
    CASE WHEN message = '' THEN 'missing:message' END,
    CASE WHEN kind = 'custom_notice' THEN 'unsupported:kind' END) AS reasons FROM alerts""")
def _(v: Views):
    return validate.validate_alerts(v.role("alerts")).checked.select(
        "request_id", "source", "reasons")


@query("conform_changes", """
  SELECT asset_id, upper(symbol) AS symbol, coalesce(nullif(name, ''), 'unmapped') AS name,
    substring(CAST(observed_at AS STRING), 1, 10) AS window_id, concat_ws('|',
    CASE WHEN market_cap_usd IS NULL THEN 'missing:market_cap_usd' END) AS reasons FROM bronze""")
def _(v: Views):
    return validate.conform_changes(v.role("bronze")).checked.select(
        "asset_id", "symbol", "name", "window_id", "reasons")


@query("conform_dominance", """
  SELECT dominance_group, observed_at, CASE WHEN dominance_group = 'btc'
    THEN 'missing:market_cap_usd' ELSE '' END AS reasons FROM dominance""")
def _(v: Views):
    rows = v.dominance.withColumn("market_cap_usd", F.when(
        F.col("dominance_group") != "btc", F.col("market_cap_usd")))
    return validate.conform_dominance(rows).checked.select(
        "dominance_group", "observed_at", "reasons")


@query("conform_comparison", """
  SELECT asset_id, source_record_id, CASE WHEN market_cap_rank <= 10 THEN 'large_cap'
    WHEN market_cap_rank <= 50 THEN 'mid_cap' ELSE 'broad_market' END AS correlation_bucket,
    '' AS reasons FROM bronze""")
def _(v: Views):
    return validate.conform_comparison(v.role("bronze")).checked.select(
        "asset_id", "source_record_id", "correlation_bucket", "reasons")


@query("check_contract", """
  SELECT request_id, concat_ws('|', CASE WHEN tenant_id IS NULL THEN 'required:tenant_id' END,
    CASE WHEN route_selected IN ('elsewhere', 'dashboard.market-overview')
      THEN 'enum:route_selected' END,
    CASE WHEN response_status = 'ok' THEN 'enum:response_status' END,
    CASE WHEN total_tokens = '-5' THEN 'minimum:total_tokens' END) AS reasons FROM usage_feed""")
def _(v: Views):
    return validate.check_contract(v.role("usage_feed"), validate.USAGE_CONTRACT).checked.select(
        "request_id", "reasons")


@query("validate_requests", f"""
  SELECT request_id, concat_ws('|', CASE WHEN tenant_id = '' THEN 'missing:tenant_id' END,
    CASE WHEN api_version = 'v2' THEN 'unsupported:api_version' END,
    CASE WHEN channel = 'batch' THEN 'unsupported:channel' END,
    CASE WHEN request_type_hint = 'other' THEN 'unsupported:request_type_hint' END,
    CASE WHEN length(message_text) > 2000 THEN 'too_long:message_text' END,
    CASE WHEN user_id IS NOT NULL THEN 'invalid:user_id' END,
    CASE WHEN selected_assets[2] = 'B!' THEN 'invalid:selected_assets' END) AS reasons
  FROM requests""")
def _(v: Views):
    return validate.validate_requests(v.role("requests")).checked.select("request_id", "reasons")


@query("filter_assets", "SELECT asset_id, observed_at, price_usd FROM base "
       "WHERE asset_id IN ('asset-1', 'asset-7')")
def _(v: Views):
    return validate.filter_assets(v.base, ["asset-1", "asset-7"]).select(
        "asset_id", "observed_at", "price_usd")


@query("quality_counts", "SELECT count(*) AS row_count, count(*) - count(asset_id) AS null_asset_id,"
       " count(*) - count(name) AS null_name FROM bronze")
def _(v: Views):
    return validate.quality_counts(v.role("bronze"), ["asset_id", "name"])


@query("runs_healthy", "SELECT bool_and(upper(status) IN ('SUCCESS', 'SUCCEEDED', 'COMPLETED')) "
       "AS healthy FROM runs")
def _(v: Views):
    return validate.runs_healthy(v.role("runs"))


# Silver -------------------------------------------------------------------------------------------

@query("silver_snapshots", """
  SELECT source_system, source_record_id, asset_id, upper(symbol) AS symbol,
    coalesce(name, 'unmapped') AS name, coalesce(category, 'unclassified') AS category,
    observed_at, ingested_at, market_cap_usd, price_usd, volume_24h_usd, circulating_supply,
    market_cap_rank, payload_version FROM base""")
def _(v: Views):
    return silver.silver_snapshots(v.role("bronze"))


@query("asof_lookback", """
  SELECT e.event_id, e.value, arg_max(p.value, p.ts) AS ago FROM events e LEFT JOIN events p
    ON p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 1500 MINUTE
    AND e.ts - INTERVAL 1380 MINUTE GROUP BY e.event_id, e.value""")
def _(v: Views):
    events = readers.read_table(v.spark, v.folder, "events").select(
        "event_id", "user_id", "ts", "value")
    return asof.asof_lookback(events, "user_id", "ts", "value", {"ago": (1380, 1500)}).select(
        "event_id", "value", "ago")


@query("asof_join", """
  SELECT e.event_id, arg_max(p.event_id, p.ts) AS view_id, arg_max(p.value, p.ts) AS view_value
  FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p
    ON p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 1440 MINUTE AND e.ts
  GROUP BY e.event_id""")
def _(v: Views):
    events = readers.read_table(v.spark, v.folder, "events")
    views = events.filter("event_type = 'view'").select(
        "user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof.asof_join(bought, views, "user_id", "ts", "ts", ["view_id", "view_value"]).select(
        "event_id", "view_id", "view_value")


_PCTS = "price_change_pct_1h price_change_pct_24h price_change_pct_7d"


@query("silver_changes", "SELECT * FROM changes", _PCTS)
def _(v: Views):
    return v.changes


@query("share_of_total", """
  SELECT l_shipdate, l_returnflag, qty, qty / sum(qty) OVER (PARTITION BY l_shipdate) * 100 AS pct
  FROM (SELECT l_shipdate, l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)""",
       "pct")
def _(v: Views):
    lines = readers.read_table(v.spark, v.folder, "lineitem").withColumnRenamed("l_quantity", "qty")
    return silver.share_of_total(lines, ["l_shipdate"], F.col("l_returnflag"), "l_returnflag",
                                 "qty", "pct")


@query("silver_dominance", "SELECT * FROM dominance", "market_cap_usd dominance_pct")
def _(v: Views):
    return v.dominance


@query("silver_comparison", "SELECT * FROM comparison",
       "price_change_pct_24h price_change_pct_7d")
def _(v: Views):
    return v.comparison


@query("market_formulas", """
  SELECT event_id, k, CASE WHEN k <> 0 THEN (value - k) / k * 100 END AS change,
    CASE WHEN k <> 0 THEN CAST(floor(value / k * 1000000) AS BIGINT) END AS ratio, k * 0.4::DOUBLE + value * 0.6::DOUBLE AS momentum,
    CASE WHEN k <= 10 THEN 'large_cap' WHEN k <= 50 THEN 'mid_cap' ELSE 'broad_market' END AS bucket,
    CASE WHEN value > 5 THEN 'bull' WHEN value < -5 THEN 'risk_off'
      WHEN value BETWEEN -2 AND 2 THEN 'neutral' ELSE 'bear' END AS regime
  FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
          value - 100 AS value FROM events)""", "change momentum")
def _(v: Views):
    rows = readers.read_table(v.spark, v.folder, "events").selectExpr(
        "event_id", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
        "value - 100 AS value")
    return rows.select("event_id", "k", C.pct_change("value", "k").alias("change"),
                       F.floor(C.vol_to_cap("value", "k") * 1000000).alias("ratio"),
                       C.momentum("k", "value").alias("momentum"),
                       C.cap_bucket("k").alias("bucket"), C.regime_label("value").alias("regime"))


@query("asset_enriched", "SELECT * FROM enriched", "tvl_usd")
def _(v: Views):
    return v.enriched


@query("macro_context", "SELECT * FROM macro_context",
       "current_value value_30d_ago change_30d_pct")
def _(v: Views):
    return v.macro


_FEATURES = ("price_change_pct_24h price_change_pct_7d vol_to_cap_ratio dominance_pct_btc "
             "momentum_score")


@query("market_features", "SELECT * FROM features", _FEATURES)
def _(v: Views):
    return v.features


@query("market_features_every_btc_row", f"""
  SELECT c.asset_id, c.symbol, c.observed_at, c.price_change_pct_24h, c.price_change_pct_7d,
    c.volume_24h_usd, c.market_cap_usd, CASE WHEN c.market_cap_usd <> 0
      THEN c.volume_24h_usd / c.market_cap_usd END AS vol_to_cap_ratio,
    d.dominance_pct AS dominance_pct_btc,
    c.price_change_pct_24h * 0.4::DOUBLE + c.price_change_pct_7d * 0.6::DOUBLE AS momentum_score,
    CAST(CAST(c.observed_at AS DATE) AS STRING) AS feature_date
  FROM changes c LEFT JOIN dominance d ON d.dominance_group = 'btc'
    AND d.observed_at = c.observed_at
  WHERE c.observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""", _FEATURES)
def _(v: Views):
    return enrich.market_features(v.changes, v.dominance, AS_OF, every_btc_row=True)


# Gold -----------------------------------------------------------------------------------------------

@query("gold_rankings", "SELECT * FROM g_rankings")
def _(v: Views):
    return gold.gold_rankings(v.role("bronze"))


@query("gold_movers", "SELECT * FROM g_movers", _PCTS)
def _(v: Views):
    return gold.gold_movers(v.changes)


@query("gold_dominance", "SELECT * FROM g_dominance", "market_cap_usd dominance_pct")
def _(v: Views):
    return gold.gold_dominance(v.dominance)


@query("gold_comparison", "SELECT * FROM g_comparison")
def _(v: Views):
    return gold.gold_comparison(v.comparison)


@query("gold_enriched", "SELECT * FROM g_enriched", "tvl_usd")
def _(v: Views):
    return gold.gold_enriched(v.enriched)


@query("gold_protocols", "SELECT * FROM g_protocols", "tvl_usd")
def _(v: Views):
    return gold.gold_protocols(v.enriched)


@query("gold_macro_regime", "SELECT * FROM g_macro",
       "current_value value_30d_ago change_30d_pct")
def _(v: Views):
    return gold.gold_macro_regime(v.macro)


# Freshness, quality, readiness ------------------------------------------------------------------------

@query("freshness_status", "SELECT * FROM freshness")
def _(v: Views):
    return v.freshness


@query("quality_status", "SELECT * FROM quality")
def _(v: Views):
    return v.quality


@query("serving_readiness", "SELECT * FROM serving")
def _(v: Views):
    return v.serving


def _audit(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{view}' AS object_name, count(*) AS row_count, "
        f"CAST(max({ts}) AS STRING) AS latest_observed_at FROM {view}" for view, ts in pairs)


@query("layer_audit", _audit([("bronze", "observed_at"), ("base", "observed_at"),
                              ("changes", "observed_at"), ("dominance", "observed_at"),
                              ("comparison", "observed_at"), ("g_rankings", "observed_at"),
                              ("enriched", "enriched_at"), ("g_macro", "latest_date")]))
def _(v: Views):
    tables = {"bronze": (v.role("bronze"), "observed_at"), "base": (v.base, "observed_at"),
              "changes": (v.changes, "observed_at"), "dominance": (v.dominance, "observed_at"),
              "comparison": (v.comparison, "observed_at"),
              "g_rankings": (gold.gold_rankings(v.role("bronze")), "observed_at"),
              "enriched": (v.enriched, "enriched_at"),
              "g_macro": (gold.gold_macro_regime(v.macro), "latest_date")}
    return freshness.layer_audit(tables)


@query("source_freshness", """
  SELECT source_system, max(ingested_at) AS last_ingestion, count(*) AS total_records FROM bronze
  GROUP BY 1 UNION ALL SELECT 'defillama', max(ingested_at), count(*) FROM protocols
  UNION ALL SELECT 'github', max(ingested_at), count(*) FROM repos
  UNION ALL SELECT 'fred', max(ingested_at), count(*) FROM macro""")
def _(v: Views):
    return freshness.source_freshness(v.role("bronze"), {
        fv.PROTOCOL_SOURCE: v.role("protocols"), fv.REPO_SOURCE: v.role("repos"),
        fv.MACRO_SOURCE: v.role("macro")})


@query("enrichment_health", """
  SELECT 'defillama' AS source, count(*) AS row_count, max(ingested_at) AS latest_ingest,
    count(DISTINCT source_record_id) AS unique_keys, avg(tvl_usd) AS avg_measure FROM protocols
  UNION ALL SELECT 'github', count(*), max(ingested_at), count(DISTINCT asset_id), avg(stars)
  FROM repos UNION ALL SELECT 'fred_macro', count(*), max(ingested_at),
    count(DISTINCT series_id), avg(value) FROM macro""", "avg_measure")
def _(v: Views):
    return freshness.enrichment_health({
        "defillama": (v.role("protocols"), "source_record_id", "tvl_usd"),
        "github": (v.role("repos"), "asset_id", "stars"),
        "fred_macro": (v.role("macro"), "series_id", "value")})


@query("ingest_summary", "SELECT count(*) AS row_count, max(observed_at) AS latest_observed_at, "
       "max(ingested_at) AS latest_ingested_at FROM bronze")
def _(v: Views):
    return freshness.ingest_summary(v.role("bronze"))


