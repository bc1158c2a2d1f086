"""Batch runs: land feeds, refresh silver, features, scores, alerts.

Each run writes its result before the next reads it, so lineage ends at a table and a lost
executor costs one stage of one run.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import moment
from tidemark.operators import alerts as alerting
from tidemark.operators import drift, enrich, ml, silver
from tidemark.plans import landing as landing_runs
from tidemark.sources import writers
from tidemark.sources.align import conform


def land_market(spark: SparkSession, feed_path: str, table_path: str, quarantine_path: str,
                now: datetime | str, lines: bool = False, landing: str | None = None) -> landing_runs.Landed:
    """Feed files into bronze: normalise, validate, insert what is new, keep the rejects; an empty table raises."""
    return landing_runs.land(spark, "market", feed_path, table_path, quarantine_path, now, landing, lines, min_rows=1)


def refresh_silver(spark: SparkSession, bronze_path: str, silver_path: str) -> dict[str, int]:
    """The three silver tables from bronze. The deduplicated base is written once and read by
    two builders; tables are replaced, so reruns do not repeat rows."""
    bronze = spark.read.schema(schemas.BRONZE_MARKET).parquet(bronze_path)
    base_path, written = f"{silver_path}/market_base", {}
    writers.replace_folder(silver.market_base(bronze), base_path)
    base = spark.read.parquet(base_path)
    tables = {"silver_market_changes": silver.silver_changes(base),
              "silver_market_dominance": silver.silver_dominance(bronze),
              "silver_cross_asset_comparison": silver.silver_comparison(base)}
    for name, df in tables.items():
        writers.replace_folder(df, f"{silver_path}/{name}")
        # the folder holds this run's rows only, and parquet counts them from its footers
        written[name] = spark.read.parquet(f"{silver_path}/{name}").count()
    return written


def refresh_enrichment(snapshots: DataFrame, protocols: DataFrame, repos: DataFrame,
                       observations: DataFrame, silver_path: str, as_of: datetime | str) -> None:
    writers.replace_folder(enrich.asset_enriched(snapshots, protocols, repos, as_of),
                           f"{silver_path}/silver_asset_enriched")
    writers.replace_folder(enrich.macro_context(observations, as_of),
                           f"{silver_path}/silver_macro_context")


def refresh_features(changes: DataFrame, dominance: DataFrame, path: str,
                     as_of: datetime | str, days: int = 30) -> None:
    writers.overwrite_partitioned(enrich.market_features(changes, dominance, as_of, days), path,
                                  ["feature_date"])


def train_models(features: DataFrame) -> tuple[PipelineModel | None, ml.AnomalyModel | None, float]:
    """Classifier (None unless it passes the gate), anomaly model and accuracy."""
    daily = ml.regime_features(features)
    accuracy, passed = ml.cv_gate(daily)
    if accuracy is None:
        return None, None, 0.0
    snapshot = ml.latest_snapshot(features, keep=["asset_id"])
    return (ml.train_regime(daily) if passed else None,
            ml.train_anomaly(snapshot, ids=["asset_id"]), accuracy)


def score(spark: SparkSession, features: DataFrame, regime: PipelineModel,
          anomaly: ml.AnomalyModel, scores_path: str, history_path: str,
          as_of: datetime | str) -> None:
    """Upsert the score table (one row per asset) and append to the history drift needs."""
    fresh = ml.score_assets(features, regime, anomaly, as_of)
    fresh.write.mode("append").parquet(history_path)
    target = writers._read_or_empty(spark, scores_path, schemas.GOLD_SCORES)
    merged = writers.merge_upsert_newest(target, fresh, ["asset_id"], "scored_at")
    writers.replace_folder(merged, scores_path)


def count_labels(spark: SparkSession, history_path: str, counts_path: str, scored_at: datetime | str) -> None:
    """Counts per label of the scoring run at ``scored_at`` into a folder of its own, which a rerun replaces."""
    run = spark.read.schema(schemas.GOLD_SCORES).parquet(history_path).filter(F.col("scored_at") == moment(scored_at))
    name = hashlib.md5(str(scored_at).encode()).hexdigest()
    (drift.label_counts(run).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .parquet(f"{counts_path}/run={name}"))


def watch_drift(spark: SparkSession, counts_path: str, alert_path: str, as_of: datetime | str) -> list[str]:
    """Drift from the counts of all scoring runs, without their rows: append the alert and, where it is one of too many
    within days, the call for retraining. Returns the kinds appended (none without drift)."""
    counts = spark.read.schema(schemas.LABEL_COUNTS).parquet(counts_path)
    found = drift.drift_alert(counts, as_of, weight="n").collect()  # one row at most
    if not found:
        return []
    spark.createDataFrame(found, schemas.ALERTS).write.mode("append").parquet(alert_path)
    again = drift.retrain_trigger(spark.read.schema(schemas.ALERTS).parquet(alert_path), as_of).collect()
    if again:
        spark.createDataFrame(again, schemas.ALERTS).write.mode("append").parquet(alert_path)
    return [row["kind"] for row in [*found, *again]]


def watch(usage: DataFrame, runs: DataFrame, history: DataFrame, alert_path: str,
          as_of: datetime | str, hours: float = 1) -> DataFrame:
    """Append the alerts of usage, runs and drift; returns the ones to announce."""
    found = alerting.evaluate_alerts(usage, runs, as_of, hours)
    drifted = drift.drift_alert(history, as_of)
    rows = conform(found, schemas.ALERTS).unionByName(drifted)
    rows.write.mode("append").parquet(alert_path)
    return found.filter("high_severity").drop("high_severity")
