"""Rows that once could vanish: null groups, rows without a time, tiers and jobs off the list."""

from datetime import datetime

import pytest

from tidemark import session
from tidemark.operators import drift, metrics, requests
from tidemark.operators.percentiles import p95_floor
from tests.conftest import dicts


def test_p95_keeps_the_null_group(frame):
    rows = [("a", i) for i in range(1, 21)] + [(None, i) for i in range(1, 41)]
    got = {r["k"]: r["p95_v"] for r in dicts(p95_floor(frame("k string, v int", *rows), ["k"], "v"))}
    assert got == {"a": 19, None: 38}


def test_rate_limit_keeps_rows_without_a_time(spark):
    rows = [("k", datetime(2024, 1, 1), 1), ("k", None, 2), (None, None, 3)]
    out = requests.rate_limit(spark.createDataFrame(rows, "k string, ts timestamp, i int"), ["k"], "ts", ["i"], limit=1)
    assert {r["i"]: (r["admitted"], r["retry_after_s"]) for r in dicts(out)} == {1: (True, 0), 2: (None, None), 3: (None, None)}


def test_daily_matrix_keeps_other_tiers(frame):
    daily = frame("day string, model_tier string, cost_usd double", ("d", "light", 1.0), ("d", "premium", 9.0), ("d", None, 2.0))
    row = dicts(metrics.daily_tier_matrix(daily))[0]
    assert row == {"day": "d", "light": 1.0, "standard": 2.0, "complex": 0.0, "other": 9.0}


def test_quartiles_of_all_tiers_or_the_named(frame):
    usage = frame("model_tier string, latency_ms int", ("light", 1), ("premium", 5), ("premium", 7))
    assert {r["model_tier"] for r in dicts(metrics.latency_quartiles(usage))} == {"light", "premium"}
    assert {r["model_tier"] for r in dicts(metrics.latency_quartiles(usage, ["light"]))} == {"light"}


def test_drift_alert_names_source_and_distributions(frame):
    old, new = [("bull", "2024-01-28 00:00:00")] * 9 + [("bear", "2024-01-28 00:00:00")], [("bear", "2024-01-31 00:00:00")]
    row = dicts(drift.drift_alert(frame("predicted_regime string, scored_at timestamp", *old, *new), "2024-01-31 12:00:00"))[0]
    assert row["source"] == "model_drift_monitoring_job"
    assert row["message"].endswith("dist_24h={'bear': 1.0}, dist_baseline={'bear': 0.1, 'bull': 0.9}")


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, name, default=None):
            return self.folder or default

    class Fake:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = Conf(folder), type("C", (), {"master": master})

    assert session.shared_folder(Fake("yarn", "s3a://b/c")) == "s3a://b/c"
    assert session.shared_folder(Fake("local[4]", None))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Fake(master, None))
