import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ml
from tidemark.plans import batch
from tests.conftest import dicts

NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def features(spark):
    """Twenty days of twelve assets; the 7 d change of a day decides its regime."""
    levels = [9.0, -9.0, 0.0, 3.5]
    rows = []
    for day in range(20):
        for asset in range(12):
            change = levels[day % 4] + asset * 0.01
            odd = day == 19 and asset == 11
            rows.append((f"a{asset}", "S", f"2024-01-{day + 1:02d}", change / 2, change,
                         5000.0 if odd else 100.0 + asset, 1e6 if odd else 1000.0 + asset,
                         50.0 if odd else 0.1 + asset / 100, 40.0, 1.0))
    return spark.createDataFrame(
        rows, "asset_id string, symbol string, d string, price_change_pct_24h double,"
        "price_change_pct_7d double, volume_24h_usd double, market_cap_usd double,"
        "vol_to_cap_ratio double, dominance_pct_btc double, momentum_score double").withColumn(
        "feature_date", F.to_date("d")).drop("d").persist()


def test_daily_means_drop_days_with_gaps(spark, features):
    gap = features.filter("feature_date = '2024-01-01'").withColumn(
        "dominance_pct_btc", F.lit(None).cast("double")).withColumn("feature_date", F.lit("2024-03-01").cast("date"))
    assert ml.regime_features(features.unionByName(gap)).count() == 20


def test_regime_model_learns_separable_days(features):
    daily = ml.regime_features(features)
    model = ml.train_regime(daily)
    rows = dicts(model.transform(ml.labelled(daily)))
    assert all(r["regime"] == r["predicted_regime"] for r in rows)
    importance = {r["feature"]: r["importance"] for r in dicts(ml.feature_importance(model))}
    assert set(importance) == set(ml.DAILY_FEATURES) and abs(sum(importance.values()) - 1) < 1e-6


def test_gate(features):
    daily = ml.regime_features(features)
    accuracy, passed = ml.cv_gate(daily)
    assert passed and 0.6 <= accuracy <= 1.0
    assert ml.cv_gate(daily.limit(1)) == (None, False)


def test_anomalies_are_few_and_found(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (2000, 2)))]
    rows += [(5000 + i, 12.0 + i, -12.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    model = ml.train_anomaly(df, ["x", "y"], ["id"], trees=40)
    scored = dicts(ml.anomaly_scores(df, model))
    odd = {r["id"] for r in scored if r["anomaly_score"] == -1}
    assert {5000, 5001, 5002, 5003, 5004} <= odd
    assert 0.03 <= len(odd) / len(rows) <= 0.07
    assert {r["anomaly_score"] for r in scored} == {-1, 1}
    again = ml.train_anomaly(df.repartition(7), ["x", "y"], ["id"], trees=40)
    assert all(np.array_equal(a, b) for a, b in zip(model.trees, again.trees))


def test_tree_samples_are_bounded_on_large_input(spark):
    df = spark.range(200_000).withColumn("x", F.col("id").cast("double"))
    sizes = {r["tree"]: r["count"] for r in ml._tree_samples(
        df, ["id"], ["x"], 200_000, 20, 64, 1).groupBy("tree").count().collect()}
    assert len(sizes) == 20 and max(sizes.values()) <= 64 and min(sizes.values()) > 32


def test_scoring_merges_newest_and_keeps_history(spark, features, tmp_path):
    regime, anomaly, accuracy = batch.train_models(features)
    assert regime is not None and accuracy >= 0.6
    paths = str(tmp_path / "scores"), str(tmp_path / "history")
    for now in (NOW, "2024-02-02 00:00:00"):
        batch.score(spark, features, regime, anomaly, *paths, now)
    scores = spark.read.parquet(paths[0])
    assert scores.columns == schemas.GOLD_SCORES.names
    assert scores.count() == 12 and spark.read.parquet(paths[1]).count() == 24
    rows = dicts(scores)
    assert {str(r["scored_at"]) for r in rows} == {"2024-02-02 00:00:00"}
    assert {r["anomaly_score"] for r in rows} <= {-1, 1}
    assert all(0.25 <= r["regime_confidence"] <= 1.0 for r in rows)


def test_features_round_trip_by_date(spark, features, tmp_path):
    changes = features.withColumn("observed_at", F.col("feature_date").cast("timestamp")).select(
        "asset_id", "symbol", "observed_at", "price_change_pct_24h", "price_change_pct_7d",
        "volume_24h_usd", "market_cap_usd")
    dominance = spark.createDataFrame([], schemas.SILVER_DOMINANCE)
    path = str(tmp_path / "features")
    batch.refresh_features(changes, dominance, path, "2024-01-25 00:00:00")
    assert spark.read.parquet(path).count() == 240


def test_champion(frame):
    runs = frame("model_name string, version long, trained_at timestamp, cv_accuracy double, path string",
                 ("m", 1, "2024-01-01 00:00:00", 0.7, "p1"), ("m", 2, "2024-01-02 00:00:00", 0.5, "p2"),
                 ("m", 3, "2024-01-03 00:00:00", 0.6, "p3"), ("n", 1, "2024-01-01 00:00:00", 0.1, "q"))
    rows = dicts(ml.champion(runs))
    assert [(r["model_name"], r["version"], r["previous_version"]) for r in rows] == [("m", 3, 1)]


def test_the_scoring_query_computes_features_once(spark, features):
    from tidemark.workload.text import QUERIES
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    class Given:
        pass

    Given.features = features.mapInArrow(counted, features.schema)
    rows = dicts(QUERIES["score_assets"][0](Given))
    assert len(rows) == 12 and all(r["valid"] for r in rows)
    assert passed.value == 240


def test_grids_find_the_leaves_of_a_walk(spark, monkeypatch):
    """Cuts met exactly, missing and endless values, and values beyond all of the sample."""
    rng = np.random.default_rng(5)
    sample = np.column_stack([rng.integers(0, 9, 256), rng.normal(0, 1, 256), np.zeros(256)])
    trees = [ml._grow(sample, np.random.default_rng(i), 8) for i in range(6)]
    cuts = ml._forest_cuts(trees, 3)
    values = np.concatenate([sample, np.array([[np.nan, 0.1, 0.0], [99.0, np.inf, -np.inf], [-99.0, np.nan, np.nan]]),
                             np.array([[cuts[0][0], c, 0.0] for c in cuts[1]])])
    for tree in trees:
        cells = ml._cells(tree, cuts)
        at = sum(step[np.searchsorted(c, x, side="right")] for step, c, x in zip(cells.steps, cuts, values.T))
        for row, found in zip(values, cells.path[cells.leaf[at]]):
            node = 0
            while tree[node, 0] >= 0:
                node = int(tree[node, 2] if row[int(tree[node, 0])] < tree[node, 1] else tree[node, 3])
            assert tree[node, 4] == found
    model = ml.AnomalyModel(["x", "y", "z"], trees, 256, 0.5)
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], "x double, y double, z double")
    raw = lambda: sorted(r["anomaly_raw"] for r in dicts(ml.anomaly_scores(df, model)))
    by_grid = raw()
    monkeypatch.setattr(ml, "_cells", lambda *a: None)
    assert ml._cells(trees[0], cuts) is None and len(by_grid) == len(values) and raw() == by_grid
