"""Drift from the counts of scoring runs."""

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import drift
from tidemark.plans import batch
from tidemark.sources.align import conform
from tests.conftest import dicts


def test_drift_and_retraining_from_counts(spark, frame, tmp_path):
    history, counts, alerts = (str(tmp_path / name) for name in ("history", "counts", "alerts"))
    runs = {f"2024-01-{day:02d} 06:00:00": [("bull" if day < 20 else "bear", 9), ("flat", 1 if day < 20 else 3), (None, 1)]
            for day in range(12, 23)}
    said = []
    for at, labels in runs.items():
        rows = frame("scored_at timestamp, predicted_regime string, k int",
                     *[(at, label, k) for label, n in labels for k in range(n)])
        conform(rows, schemas.GOLD_SCORES).write.mode("append").parquet(history)
        for _ in range(1 + (at in list(runs)[:2])):  # a rerun counts nothing twice
            batch.count_labels(spark, history, counts, at)
        if at >= "2024-01-19":
            said.append(batch.watch_drift(spark, counts, alerts, at.replace("06:", "07:")))
    rows, stored = spark.read.parquet(history), spark.read.schema(schemas.LABEL_COUNTS).parquet(counts)
    assert stored.agg(F.sum("n")).first()[0] == rows.count()
    for at in ("2024-01-10 00:00:00", "2024-01-13 06:00:00", "2024-01-20 07:00:00", "2024-01-21 05:59:59", "2024-01-25 00:00:00"):
        assert dicts(drift.drift_psi(stored, at, "n")) == dicts(drift.drift_psi(rows, at))
        assert dicts(drift.drift_alert(stored, at, weight="n")) == dicts(drift.drift_alert(rows, at))
    assert said == [[], ["model_drift"], ["model_drift"], ["model_drift", "retrain_trigger"]]
    assert spark.read.parquet(alerts).count() == 4
