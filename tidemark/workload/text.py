"""Request text, access, drift, model, admission and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import text as T
from tidemark.operators import access, drift, ml, requests
from tidemark.operators.freshness import union_all
from tidemark.plans.layers import register_layers
from tidemark.session import cut_lineage, run_folder, written
from tidemark.sources import readers
from tidemark.streaming.health import stream_route_health
from tidemark.workload.roles import AS_OF, ROLES
from tidemark.workload.views import Views, sql

QUERIES: dict = {}


def query(name: str, text: str | None = None, round6: str = ""):
    def register(build):
        QUERIES[name] = (build, sql(text, round6) if text else None)
        return build
    return register


def _found(column: str, words: list[str]) -> str:
    cases = ", ".join("CASE WHEN contains(lower({c}), '{w}') THEN '{w}' END".format(
        c=column, w=word.replace("'", "''")) for word in words)
    return f"concat_ws('|', {cases})"


_WORDS = "len(regexp_extract_all({c}, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'))"
_ROUTE_SQL = f"""SELECT *, CASE WHEN s <> '' THEN 'genie' ELSE 'copilot' END AS route,
  CASE WHEN s <> '' THEN 'structured_analytics_request' WHEN t <> '' THEN 'narrative_market_request'
    ELSE 'default_copilot_path' END AS route_reason,
  CASE WHEN s <> '' THEN s ELSE t END AS route_signals
  FROM (SELECT *, {_found('text', fv.STRUCTURED_SIGNALS)} AS s,
    {_found('text', fv.NARRATIVE_SIGNALS)} AS t FROM {{source}})"""


@query("classify_route", f"SELECT doc_id, route, route_reason, route_signals "
       f"FROM ({_ROUTE_SQL.format(source='documents')})")
def _(v: Views):
    docs = readers.read_table(v.spark, v.folder, "documents").select("doc_id", "text")
    return requests.classify_route(docs, "text").drop("text")


_TIER_SQL = f"""SELECT *, CASE WHEN cx <> '' OR w >= 60 OR assets >= 4 OR turns >= 5 THEN 'complex'
    WHEN lt <> '' AND w <= 12 AND turns <= 1 AND assets <= 1 THEN 'light' ELSE 'standard' END AS tier
  FROM (SELECT request_id, asset_count AS assets, turns - 60 AS turns,
    CAST({_WORDS.format(c='message_text')} AS INT) AS w,
    {_found('message_text', fv.COMPLEX_SIGNALS)} AS cx,
    {_found('message_text', fv.LIGHT_SIGNALS)} AS lt FROM requests)"""


@query("classify_tier", f"""SELECT request_id, tier,
  CASE WHEN cx <> '' THEN 'complex_signal' WHEN w >= 60 THEN 'long_query'
    WHEN assets >= 4 THEN 'high_asset_count' WHEN turns >= 5 THEN 'deep_conversation'
    WHEN tier = 'light' THEN 'simple_factual_lookup' ELSE 'standard_market_analysis' END AS tier_reason,
  CASE tier WHEN 'complex' THEN cx WHEN 'light' THEN lt ELSE '' END AS tier_signals,
  CAST(greatest(w * 2, CASE tier WHEN 'complex' THEN 200 WHEN 'light' THEN 30 ELSE 80 END) AS INT)
    AS estimated_prompt_tokens FROM ({_TIER_SQL})""")
def _(v: Views):
    rows = v.role("requests").withColumn("turns", F.col("turns") - 60)
    return requests.classify_tier(rows, "message_text", "asset_count", "turns").select(
        "request_id", "tier", "tier_reason", "tier_signals", "estimated_prompt_tokens")


@query("word_count", f"SELECT doc_id, CAST({_WORDS.format(c='text')} AS INT) AS words FROM documents")
def _(v: Views):
    docs = readers.read_table(v.spark, v.folder, "documents")
    return docs.select("doc_id", T.word_count("text").alias("words"))


@query("estimate_cost", """SELECT request_id, floor(total_tokens / 1000.0::DOUBLE * CASE model_tier
  WHEN 'light' THEN 0.0008::DOUBLE WHEN 'standard' THEN 0.004::DOUBLE WHEN 'complex'
  THEN 0.025::DOUBLE ELSE 0.004::DOUBLE END * 1000000 + 0.5)::BIGINT AS micro_usd FROM usage""")
def _(v: Views):
    rows = requests.estimate_cost(v.role("usage"))
    return rows.select("request_id", F.round(F.col("cost_usd") * 1e6).cast("bigint").alias("micro_usd"))


@query("sanitize", """SELECT doc_id, md5(c) AS digest, CAST(length(c) AS INT) AS chars FROM (SELECT doc_id,
  substring(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'),
  '^\\s+|\\s+$', '', 'g'), 1, 2000) AS c FROM documents)""")
def _(v: Views):
    docs = readers.read_table(v.spark, v.folder, "documents")
    clean = docs.select("doc_id", T.sanitize("text").alias("c"))
    return clean.select("doc_id", F.md5(F.encode("c", "UTF-8")).alias("digest"),
                        F.length("c").alias("chars"))


_SURFACE = f"""SELECT request_id, CASE request_type_hint WHEN 'dashboard_query' THEN 'dashboard'
    WHEN 'analytics_nlq' THEN 'genie' WHEN 'copilot' THEN 'copilot'
    ELSE CASE WHEN channel = 'web_dashboard' AND lower(trim(text)) IN
      ('market overview', 'visao geral do mercado') THEN 'dashboard' ELSE route END END AS surface
  FROM ({_ROUTE_SQL.format(source='(SELECT *, message_text AS text FROM requests)')})"""


@query("dispatch", f"SELECT *, surface <> 'dashboard' AS rate_limited_surface FROM ({_SURFACE})")
def _(v: Views):
    return requests.dispatch(v.role("requests")).select(
        "request_id", "surface", "rate_limited_surface")


@query("usage_rows", f"""SELECT request_id, tenant_id, user_id,
  CASE WHEN channel = 'web_dashboard' THEN 'dashboard.market-overview' ELSE route END AS route_selected,
  CASE WHEN channel = 'web_dashboard' THEN 'dashboard-api' ELSE 'mosaic-ai-agent-framework' END
    AS model_or_engine,
  CASE WHEN channel <> 'web_dashboard' THEN 'standard' END AS model_tier,
  CAST(length(message_text) AS INT) AS latency_ms, 'success' AS response_status
  FROM ({_ROUTE_SQL.format(source='(SELECT *, message_text AS text FROM requests)')})""")
def _(v: Views):
    asked = v.role("requests")
    none = lambda kind: F.lit(None).cast(kind)
    answered = asked.select(
        "request_id", F.when(F.col("channel") == "web_dashboard", "dashboard_payload")
        .otherwise("copilot_answer").alias("surface_type"),
        F.lit(AS_OF).cast("timestamp").alias("responded_at"), none("string").alias("model_id"),
        none("string").alias("model_tier"), none("int").alias("prompt_tokens"),
        none("int").alias("completion_tokens"), none("int").alias("total_tokens"),
        F.length("message_text").alias("latency_ms"), none("double").alias("cost_estimate"),
        none("string").alias("freshness_watermark"))
    return requests.usage_rows(asked, answered).select(
        "request_id", "tenant_id", "user_id", "route_selected", "model_or_engine", "model_tier",
        "latency_ms", "response_status")


@query("merge_sources", """
  WITH f AS (SELECT l_orderkey, source, min(pos) AS pos FROM (SELECT l_orderkey,
      'supplier-' || l_suppkey AS source, l_linenumber * 10 AS pos FROM lineitem
      UNION ALL SELECT l_orderkey, 'flag-' || l_returnflag, l_linenumber * 10 + 1 FROM lineitem)
    GROUP BY 1, 2)
  SELECT l_orderkey AS request_id, string_agg(source, '|' ORDER BY pos, source) AS sources,
    any_value(t) AS total_tokens FROM f JOIN (SELECT l_orderkey,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS t FROM lineitem GROUP BY 1) USING (l_orderkey)
  GROUP BY l_orderkey""")
def _(v: Views):
    parts = readers.read_table(v.spark, v.folder, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("part"),
        F.array(F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")),
                F.concat(F.lit("flag-"), F.col("l_returnflag"))).alias("sources"),
        F.col("l_quantity").cast("bigint").alias("token_count"))
    return requests.merge_sources(parts)


@query("row_filter", "SELECT request_id, user_id FROM usage WHERE user_id = 'user-3'")
def _(v: Views):
    return access.row_filter(v.role("usage"), "user-3", ["analysts"]).select("request_id", "user_id")


@query("row_filter_admin", "SELECT request_id, user_id FROM usage")
def _(v: Views):
    return access.row_filter(v.role("usage"), "user-3", ["platform_ops"]).select(
        "request_id", "user_id")


@query("column_mask", "SELECT request_id, CAST(NULL AS DOUBLE) AS cost_estimate FROM usage")
def _(v: Views):
    return access.mask(v.role("usage"), "cost_estimate", ["analysts"]).select(
        "request_id", "cost_estimate")


# Drift --------------------------------------------------------------------------------------------

_DAY, _WEEK = (f"TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY" for d in (1, 7))


def _shares(where: str, table: str = "scores", label: str = "predicted_regime") -> str:
    return (f"SELECT {label} AS label, count(*) / sum(count(*)) OVER () AS share FROM {table} "
            f"WHERE {where} GROUP BY 1")


_PSI = f"""SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (
  SELECT coalesce(c.share, 0.001) AS a, coalesce(b.share, 0.001) AS e
  FROM ({_shares(f'scored_at >= {_WEEK} AND scored_at < {_DAY}')}) b
  FULL JOIN ({_shares(f'scored_at >= {_DAY}')}) c USING (label))"""


@query("label_distribution", _shares("TRUE"), "share")
def _(v: Views):
    return drift.label_distribution(v.role("scores"))


@query("label_distribution_of_labels", _shares("TRUE", "labels", "CAST(quality AS STRING)"), "share")
def _(v: Views):
    labels = readers.read_table(v.spark, v.folder, "labels")
    return drift.label_distribution(labels, label="quality")


@query("drift_psi", _PSI)
def _(v: Views):
    return drift.drift_psi(v.role("scores"), AS_OF)


@query("drift_alert", f"""SELECT 'model_drift' AS kind, printf('Regime PSI=%.3f exceeds threshold 0.2 (24h distribution vs 7d-1d baseline, non-overlapping windows).', psi) AS message,
  'model_drift_monitoring_job' AS source, true AS distributions FROM ({_PSI}) WHERE psi >= 0.2""")
def _(v: Views):
    rows = drift.drift_alert(v.role("scores"), AS_OF)
    told = F.col("message").rlike(r" dist_24h=\{'.+': 0.*\}, dist_baseline=\{'.+': 0.*\}$")
    return rows.select("kind", F.substring_index("message", " dist_24h=", 1).alias("message"), "source",
                       told.alias("distributions"))


@query("retrain_trigger", f"""SELECT 'retrain_trigger' AS kind, 'Sustained regime drift detected: ' || n
  || ' PSI breaches in last 3 days. Manual or automated retraining recommended.' AS message,
  'model_drift_monitoring_job' AS source
  FROM (SELECT count(*) AS n FROM alerts WHERE kind = 'model_drift'
    AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY) WHERE n >= 3""")
def _(v: Views):
    return drift.retrain_trigger(v.role("alerts"), AS_OF).select("kind", "message", "source")


# Models ---------------------------------------------------------------------------------------------

_DAILY = """SELECT feature_date, avg(price_change_pct_24h) AS avg_price_change_pct_24h,
  avg(price_change_pct_7d) AS avg_price_change_pct_7d,
  avg(dominance_pct_btc) AS avg_dominance_pct_btc, avg(vol_to_cap_ratio) AS avg_vol_to_cap_ratio
  FROM features GROUP BY 1"""
_WHOLE = """avg_price_change_pct_24h IS NOT NULL AND avg_price_change_pct_7d IS NOT NULL
  AND avg_dominance_pct_btc IS NOT NULL AND avg_vol_to_cap_ratio IS NOT NULL"""
_AVERAGES = " ".join(ml.DAILY_FEATURES)


@query("regime_features", f"SELECT * FROM ({_DAILY}) WHERE {_WHOLE}", _AVERAGES)
def _(v: Views):
    return ml.regime_features(v.features)


@query("regime_labels", f"""SELECT feature_date, CASE WHEN avg_price_change_pct_7d > 5 THEN 'bull'
  WHEN avg_price_change_pct_7d < -5 THEN 'risk_off' WHEN avg_price_change_pct_7d BETWEEN -2 AND 2
  THEN 'neutral' ELSE 'bear' END AS regime FROM ({_DAILY}) WHERE {_WHOLE}""")
def _(v: Views):
    return ml.labelled(ml.regime_features(v.features)).select("feature_date", "regime")


@query("latest_snapshot", """SELECT vol_to_cap_ratio, price_change_pct_24h, market_cap_usd
  FROM features WHERE feature_date = (SELECT max(feature_date) FROM features)
  AND vol_to_cap_ratio IS NOT NULL AND price_change_pct_24h IS NOT NULL
  AND market_cap_usd IS NOT NULL""", "vol_to_cap_ratio price_change_pct_24h")
def _(v: Views):
    return ml.latest_snapshot(v.features)


_RULE = """CASE WHEN avg_price_change_pct_7d > 5 THEN 'bull' WHEN avg_price_change_pct_7d < -5 THEN 'risk_off'
  WHEN avg_price_change_pct_7d BETWEEN -2 AND 2 THEN 'neutral' ELSE 'bear' END"""


@query("train_regime", f"""SELECT feature_date, {_RULE} AS regime, true AS learned FROM ({_DAILY}) WHERE {_WHOLE}""")
def _(v: Views):
    """Days with the rule's label; the forest must give most days of its own training their label."""
    daily = cut_lineage(ml.regime_features(v.features))
    rows = ml.train_regime(daily).transform(ml.labelled(daily))
    right = F.avg(F.when(F.col("regime") == F.col("predicted_regime"), 1.0).otherwise(0.0))
    learned = rows.agg((right >= 0.9).alias("learned"))
    return rows.select("feature_date", "regime").crossJoin(F.broadcast(learned))


@query("cv_gate", f"""SELECT count(*) AS days, true AS consistent FROM ({_DAILY}) WHERE {_WHOLE}""")
def _(v: Views):
    """Days judged, and whether the verdict follows from the accuracy."""
    daily = cut_lineage(ml.regime_features(v.features))
    accuracy, passed = ml.cv_gate(daily)
    follows = (accuracy is None and not passed) or (accuracy is not None and 0 <= accuracy <= 1 and passed == (accuracy >= 0.6))
    return daily.agg(F.count(F.lit(1)).alias("days")).select("days", F.lit(follows).alias("consistent"))


@query("feature_importance", "SELECT unnest([" + ", ".join(f"'{c}'" for c in ml.DAILY_FEATURES) + "]) AS feature, "
       "true AS whole")
def _(v: Views):
    """The features; their importances add up to 1, or to 0 where all days have one label."""
    rows = ml.feature_importance(ml.train_regime(cut_lineage(ml.regime_features(v.features))))
    whole = rows.agg(F.round(F.sum("importance"), 6).isin(0.0, 1.0).alias("whole"))
    return rows.select("feature").crossJoin(F.broadcast(whole))


@query("anomaly_scores", "SELECT count(*) AS n, true AS within, true AS odd_first FROM lineitem")
def _(v: Views):
    """Rows labelled; at most 5 % of them odd, up to ties at the cut, and none odd below a normal one."""
    lines = readers.read_table(v.spark, v.folder, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    ids = ["l_orderkey", "l_linenumber"]
    rows = ml.fit_anomaly_scores(lines.select(*ids, *columns), columns, ids)
    odd, raw = F.col("anomaly_score") == -1, F.col("anomaly_raw")
    share = F.count_if(odd) / F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n"), share.between(0.02, 0.05).alias("within"),
                    (F.min(F.when(odd, raw)) > F.max(F.when(~odd, raw))).alias("odd_first"))


@query("score_assets", f"""SELECT asset_id, symbol, momentum_score, TIMESTAMP '{AS_OF}' AS scored_at, true AS valid
  FROM features WHERE feature_date = (SELECT max(feature_date) FROM features)
  AND price_change_pct_24h IS NOT NULL AND price_change_pct_7d IS NOT NULL AND dominance_pct_btc IS NOT NULL
  AND vol_to_cap_ratio IS NOT NULL AND market_cap_usd IS NOT NULL""", "momentum_score")
def _(v: Views):
    features = written(v.features, "features")  # read six times below
    daily = cut_lineage(ml.regime_features(features))
    model = ml.train_anomaly(ml.latest_snapshot(features, keep=["asset_id"]), ids=["asset_id"])
    rows = ml.score_assets(features, ml.train_regime(daily), model, AS_OF)
    valid = F.col("anomaly_score").isin(-1, 1) & F.col("regime_confidence").between(0.25, 1.0) & F.col("predicted_regime").isin("bull", "bear", "neutral", "risk_off")
    return rows.select("asset_id", "symbol", "momentum_score", "scored_at", valid.alias("valid"))


@query("champion", """SELECT model_name, version, trained_at, cv_accuracy, path, previous_version
  FROM (SELECT *, lead(version) OVER w AS previous_version, row_number() OVER w AS r FROM
    (SELECT o_orderpriority AS model_name, o_orderkey AS version,
      CAST(o_orderdate AS TIMESTAMP) AS trained_at, o_totalprice / 500000 AS cv_accuracy,
      'models/' || o_orderkey AS path FROM orders) WHERE cv_accuracy >= 0.6
    WINDOW w AS (PARTITION BY model_name ORDER BY trained_at DESC, version DESC)) WHERE r = 1""",
       "cv_accuracy")
def _(v: Views):
    runs = readers.read_table(v.spark, v.folder, "orders").select(
        F.col("o_orderpriority").alias("model_name"), F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").cast("timestamp").alias("trained_at"),
        (F.col("o_totalprice") / 500000).alias("cv_accuracy"),
        F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("path"))
    return ml.champion(runs)


def admission_sql(events: str, limit: int, seconds: int) -> str:
    """Admission event by event: each key's admitted times inside the window are carried along."""
    width = seconds * 1_000_000
    return f"""WITH RECURSIVE e AS (SELECT event_id, k, epoch_us(seen) AS t,
      row_number() OVER (PARTITION BY k ORDER BY seen, event_id) AS n FROM ({events}) WHERE seen IS NOT NULL),
    r AS (SELECT event_id, k, n, [t] AS held, true AS admitted, CAST(0 AS BIGINT) AS retry_after_s FROM e WHERE n = 1
      UNION ALL SELECT event_id, k, n, CASE WHEN len(kept) < {limit} THEN list_append(kept, t) ELSE kept END,
        len(kept) < {limit}, CASE WHEN len(kept) < {limit} THEN 0 ELSE greatest(1, (kept[1] + {width} - t) // 1000000) END
      FROM (SELECT e.*, list_filter(r.held, lambda x: x > e.t - {width}) AS kept
            FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1))
    SELECT event_id, admitted, retry_after_s FROM r
    UNION ALL SELECT event_id, NULL, NULL FROM ({events}) WHERE seen IS NULL"""


# Admission and streams ------------------------------------------------------------------------------

@query("rate_limit", admission_sql("""SELECT *, concat_ws(':', user_id, event_type) AS k,
    CASE WHEN event_id % 97 <> 0 THEN ts END AS seen FROM events""", 1, 86400))
def _(v: Views):
    """Admission per user and event type, one a day; every 97th event has lost its time."""
    events = readers.read_table(v.spark, v.folder, "events").select(
        "event_id", F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"), "event_type", "user_id")
    rows = requests.rate_limit(events, ["user_id", "event_type"], "ts", ["event_id"], limit=1, seconds=86400)
    return rows.select("event_id", "admitted", "retry_after_s")


@query("stream_route_health", "SELECT * FROM health WHERE hour_bucket < (SELECT max(hour_bucket) "
       "FROM health)", "avg_latency_ms total_cost_estimate")
def _(v: Views):
    """The hourly health of the event table read as a stream; the newest hour is still open."""
    spec = ROLES["usage"]
    stream = (readers.stream_table(v.spark, v.folder, spec.table).selectExpr(*spec.prepare)
              .selectExpr(*[f"{expr} AS {name}" for name, expr in spec.columns.items()]))
    out = run_folder(v.spark, "route-health")
    (stream_route_health(stream, "0 seconds").writeStream.outputMode("append").format("parquet")
     .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return v.spark.read.parquet(f"{out}/rows")


@query("register_layers", """
  SELECT 'gold_enriched_rankings' AS view_name, count(*) AS n FROM g_enriched
  UNION ALL SELECT 'mv_enriched_rankings', count(*) FROM g_enriched
  UNION ALL SELECT 'gold_macro_regime', count(*) FROM g_macro
  UNION ALL SELECT 'gold_market_rankings', count(*) FROM g_rankings
  UNION ALL SELECT 'ops_route_health', count(*) FROM health
  UNION ALL SELECT 'ops_bundle_run_readiness', count(*) FROM runs_r""")
def _(v: Views):
    register_layers(v.spark, {
        "bronze_market_snapshots": v.role("bronze"), "bronze_protocols": v.role("protocols"),
        "bronze_repo_activity": v.role("repos"), "bronze_macro": v.role("macro"),
        "silver_asset_enriched": v.enriched, "silver_macro_context": v.macro,
        "ops_usage_events": v.role("usage"), "ops_bundle_runs": v.role("runs"),
        "ops_alerts": v.role("alerts")}, AS_OF)
    names = ["gold_enriched_rankings", "mv_enriched_rankings", "gold_macro_regime",
             "gold_market_rankings", "ops_route_health", "ops_bundle_run_readiness"]
    return union_all([v.spark.table(name).agg(F.count(F.lit(1)).alias("n"))
                      .select(F.lit(name).alias("view_name"), "n") for name in names])
