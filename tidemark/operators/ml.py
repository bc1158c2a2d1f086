"""Regime classifier, anomaly scores, batch scoring, model choice."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import moment, regime_label
from tidemark.session import written
from tidemark.sources.align import conform

AsOf = datetime | str | Column
DAILY_FEATURES = ["avg_price_change_pct_24h", "avg_price_change_pct_7d",
                  "avg_dominance_pct_btc", "avg_vol_to_cap_ratio"]
ASSET_FEATURES = ["price_change_pct_24h", "price_change_pct_7d", "dominance_pct_btc",
                  "vol_to_cap_ratio"]
ANOMALY_FEATURES = ["vol_to_cap_ratio", "price_change_pct_24h", "market_cap_usd"]


def regime_features(features: DataFrame) -> DataFrame:
    """Daily means, days with a missing mean dropped; one row per day from here on."""
    return (features.groupBy("feature_date")
            .agg(*[F.avg(F.nanvl(name, F.lit(None))).alias(f"avg_{name}")
                   for name in ASSET_FEATURES]).na.drop())


def labelled(daily: DataFrame) -> DataFrame:
    """The label is a rule on one of the features, so accuracies measured on it are optimistic."""
    return daily.withColumn("regime", regime_label("avg_price_change_pct_7d"))


def _forest() -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=50, seed=42)


def train_regime(daily: DataFrame) -> PipelineModel:
    rows = labelled(daily)
    indexer = StringIndexer(inputCol="regime", outputCol="label",
                            stringOrderType="alphabetAsc").fit(rows)
    return Pipeline(stages=[
        indexer, VectorAssembler(inputCols=DAILY_FEATURES, outputCol="features"), _forest(),
        IndexToString(inputCol="prediction", outputCol="predicted_regime",
                      labels=indexer.labels)]).fit(rows)


def cv_accuracy(daily: DataFrame, folds: int = 5) -> float | None:
    """Mean k-fold accuracy with k = min(folds, days); None where there are fewer than two days."""
    rows = labelled(daily)
    k = min(folds, rows.count())
    if k < 2:
        return None
    indexed = StringIndexer(inputCol="regime", outputCol="label").fit(rows).transform(rows)
    # Every k-th day of the date order in a fold of its own: no fold is ever empty.
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("feature_date"))
    placed = indexed.withColumn("fold", (position % k).cast("int")).persist()
    validator = CrossValidator(
        estimator=Pipeline(stages=[VectorAssembler(inputCols=DAILY_FEATURES,
                                                   outputCol="features"), _forest()]),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=k, foldCol="fold", seed=42, parallelism=k)
    accuracy = float(validator.fit(placed).avgMetrics[0])
    placed.unpersist()
    return accuracy


def cv_gate(daily: DataFrame, minimum: float = 0.60, folds: int = 5) -> tuple[float | None, bool]:
    """(accuracy, may be promoted)."""
    accuracy = cv_accuracy(daily, folds)
    return accuracy, accuracy is not None and accuracy >= minimum


def feature_importance(model: PipelineModel) -> DataFrame:
    forest = next(stage for stage in model.stages if hasattr(stage, "featureImportances"))
    rows = [(name, float(value)) for name, value in
            zip(DAILY_FEATURES, forest.featureImportances.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def latest_snapshot(features: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES),
                    keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the latest date without missing values (the broadcast side is one row)."""
    newest = features.agg(F.max("feature_date").alias("feature_date"))
    return (features.join(F.broadcast(newest), "feature_date", "left_semi")
            .select(*keep, *columns).na.drop(subset=list(columns)))


# Anomaly detector -----------------------------------------------------------------------------------
# Isolation forest (Liu, Ting, Zhou 2008): short paths in random trees over small samples mark
# outliers. Trees and samples are bounded by parameters, so growing a tree is one small task and
# the forest itself is a broadcast of fixed size.

CELLS = 1 << 19  # of a tree's grid, of a byte each where it has up to 256 leaves


class AnomalyModel(NamedTuple):
    columns: list[str]
    trees: list[np.ndarray]  # per tree: feature, threshold, left, right, leaf depth
    sample: int
    threshold: float


def _harmonic_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    nodes: list[list[float]] = []
    todo = [(rows, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
        if depth >= limit or len(part) <= 1 or not len(spread):
            nodes.append([-1, 0.0, 0, 0, depth + _harmonic_path(len(part))])
            continue
        feature = int(rng.choice(spread))
        values = part[:, feature]
        cut = rng.uniform(values.min(), values.max())
        nodes.append([feature, cut, 0, 0, 0.0])
        below = values < cut
        todo += [(part[below], depth + 1, me, 0), (part[~below], depth + 1, me, 1)]
    return np.array(nodes)


def _tree_samples(df: DataFrame, ids: Sequence[str], columns: Sequence[str], rows: int,
                  trees: int, sample: int, seed: int) -> DataFrame:
    """Up to ``sample`` rows per tree, drawn by hash so that reruns agree.

    Each tree draws each row with the same chance, on its own. One hash tells how many trees a row
    serves (by the binomial distribution), further hashes tell which; rows that serve none are dropped
    before anything is multiplied, so one rule holds at every size. ``sample`` is the algorithm's own
    parameter, the rows a tree is grown from.
    """
    unit = lambda salt: (F.pmod(F.xxhash64(*ids, *columns, salt), F.lit(1 << 40))
                         / F.lit(float(1 << 40)))
    share = min(1.0, 1.5 * sample / max(rows, 1))
    below, chance, limits = 0.0, (1.0 - share) ** trees, []  # chance of serving exactly k trees
    for k in range(trees):
        below += chance
        if share == 1.0 or below >= 1.0 - 1e-15:
            break
        limits.append(below)
        chance *= (trees - k) / (k + 1) * share / (1.0 - share)
    base = df.select(*ids, *columns).withColumn("_u", unit(F.lit(seed)))
    if share == 1.0:
        serves = F.lit(trees)
    else:
        steps = F.array(*[F.lit(x) for x in limits])
        serves = F.size(F.filter(steps, lambda x: x <= F.col("_u")))
        base = base.filter(F.col("_u") >= F.lit(limits[0] if limits else 1.0))  # nearly all rows serve none and end here
    base = base.withColumn("_serves", serves)
    shuffled = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        F.xxhash64(*ids, *columns, t + seed).alias("h"), t.alias("tree"))))
    drawn = (base.filter("_serves > 0")
             .withColumn("tree", F.explode(F.slice(shuffled, F.lit(1), F.col("_serves"))["tree"])))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(
        F.xxhash64(*ids, *columns, F.col("tree") + seed + 1), *ids))
    return drawn.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select("tree", *columns)


def _grow_forest(df: DataFrame, columns: Sequence[str], ids: Sequence[str], trees: int,
                 sample: int, seed: int) -> AnomalyModel:
    columns, total = list(columns), df.count()
    size = max(2, min(sample, total))
    limit = int(np.ceil(np.log2(size)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        # the shuffle does not keep an order: sort, so that the same sample gives the same tree
        rows = pdf.sort_values(columns)[columns].to_numpy(float)
        nodes = _grow(rows, np.random.default_rng(seed + tree), limit)
        return pd.DataFrame({"tree": [tree], "nodes": [nodes.ravel().tolist()]})

    samples = _tree_samples(df, ids, columns, total, trees, sample, seed)
    # at most ``trees`` rows of at most 2 * sample nodes come back
    grown = samples.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").collect()
    forest = [np.array(row["nodes"]).reshape(-1, 5) for row in sorted(grown, key=lambda r: r["tree"])]
    return AnomalyModel(columns, forest, size, 2.0)


class _Cells(NamedTuple):
    """A tree as a grid: ``steps`` has per feature the offset of a row's rank among all cuts of the forest, and the sum
    of a row's offsets is the place of its leaf's number in ``leaf``."""

    steps: list[np.ndarray]
    leaf: np.ndarray
    path: np.ndarray


def _forest_cuts(trees: Sequence[np.ndarray], width: int) -> list[np.ndarray]:
    """Per feature all cuts of the forest, ascending."""
    nodes = np.concatenate(trees) if trees else np.zeros((0, 5))
    return [np.unique(nodes[nodes[:, 0] == j, 1]) for j in range(width)]


def _cells(tree: np.ndarray, cuts: Sequence[np.ndarray]) -> _Cells | None:
    """The grid between a tree's own cuts; None where it would have more than CELLS cells."""
    own = [np.unique(tree[tree[:, 0] == j, 1]) for j in range(len(cuts))]
    shape = [len(c) + 1 for c in own]
    if np.prod(shape, dtype=float) > CELLS:
        return None
    ends = np.flatnonzero(tree[:, 0] < 0)
    number = {int(node): k for k, node in enumerate(ends)}
    leaf = np.zeros(shape, np.min_scalar_type(max(len(ends) - 1, 0)))
    todo = [(0, [(0, n) for n in shape])]
    while todo:
        node, box = todo.pop()
        if node in number:
            leaf[tuple(slice(low, high) for low, high in box)] = number[node]
            continue
        feature = int(tree[node, 0])
        low, high = box[feature]
        # ranks up to the cut's own are of values below the cut
        at = min(max(int(np.searchsorted(own[feature], tree[node, 1])) + 1, low), high)
        todo += [(int(tree[node, 2]), [*box[:feature], (low, at), *box[feature + 1:]]),
                 (int(tree[node, 3]), [*box[:feature], (at, high), *box[feature + 1:]])]
    strides = [int(np.prod(shape[j + 1:], dtype=np.int64)) for j in range(len(shape))]
    steps = [np.concatenate([[0], np.cumsum(np.isin(all_, mine))]) * stride
             for all_, mine, stride in zip(cuts, own, strides)]
    return _Cells(steps, leaf.ravel(), tree[ends, 4])


def _score(model: AnomalyModel) -> Column:
    """Anomaly score of a row: 2 to the minus (mean path length over all trees / norm).

    A value is ranked once among all cuts of its feature; from the ranks each tree's leaf is read off
    a grid. Trees whose grid would be too large (many features) are walked: leaves point to themselves,
    so all rows of a batch walk in lockstep. Both find the same leaves.
    """
    norm, depth = _harmonic_path(model.sample), int(np.ceil(np.log2(model.sample)))
    trees, width = model.trees, len(model.columns)

    def walk(tree: np.ndarray) -> tuple[np.ndarray, ...]:
        leaf, own = tree[:, 0] < 0, np.arange(len(tree))
        return (np.where(leaf, 0, tree[:, 0]).astype(np.int64), np.where(leaf, np.inf, tree[:, 1]),
                np.where(leaf, own, tree[:, 2]).astype(np.int64), np.where(leaf, own, tree[:, 3]).astype(np.int64), tree[:, 4])

    def walked(rows: np.ndarray, start: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
        feature, cut, left, right, path = tree
        at = np.zeros(len(start), dtype=np.int64)
        for _ in range(depth):
            low = rows[start + feature[at]] < cut[at]
            at = np.where(low, left[at], right[at])
        return path[at]

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        cuts = _forest_cuts(trees, width)
        forest = [_cells(tree, cuts) or walk(tree) for tree in trees]
        for series in batches:
            columns = [s.to_numpy(float) for s in series]
            ranks = [np.searchsorted(c, x, side="right") for c, x in zip(cuts, columns)]  # a missing value is above all
            rows, start = np.column_stack(columns).ravel(), np.arange(len(columns[0])) * width
            total = np.zeros(len(start))
            for tree in forest:
                if isinstance(tree, _Cells):
                    at = tree.steps[0][ranks[0]]
                    for step, rank in zip(tree.steps[1:], ranks[1:]):
                        at += step[rank]
                    total += tree.path[tree.leaf[at]]
                else:
                    total += walked(rows, start, tree)
            yield pd.Series(np.power(2.0, -total / max(len(forest), 1) / norm))

    return F.pandas_udf(score, "double")(*[F.col(name).cast("double") for name in model.columns])


def _threshold(scored: DataFrame, contamination: float) -> float:
    """The raw score at the rank that leaves ``contamination`` of the rows above it, found by counting
    rows per 2**-16 of the score and then per 2**-32 within one such range: at most 65,536 counts are
    ranked at a time, whatever the number of rows."""
    def located(rows: DataFrame, scale: int, rank: int) -> tuple[int, int, float]:
        part = F.floor(F.col("anomaly_raw") * F.lit(float(scale))).cast("long")
        counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"),
                                                      F.max("anomaly_raw").alias("high"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("part")))
        row = upto.filter(F.col("upto") >= rank).orderBy("part").first()
        return row["part"], row["upto"] - row["n"], row["high"]

    total = scored.count()
    if not total:
        return 2.0
    rank = max(1, int(np.ceil(total * (1.0 - contamination))))
    part, before, _ = located(scored, 1 << 16, rank)
    inside = scored.filter(F.floor(F.col("anomaly_raw") * F.lit(float(1 << 16))) == part)
    return float(located(inside, 1 << 32, rank - before)[2])


def _label(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("anomaly_score",
                             F.when(F.col("anomaly_raw") > threshold, -1).otherwise(1))


def train_anomaly(df: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES),
                  ids: Sequence[str] = (), contamination: float = 0.05, trees: int = 100,
                  sample: int = 256, seed: int = 42) -> AnomalyModel:
    rows = written(df.select(*ids, *[F.col(name).cast("double").alias(name) for name in columns]), "anomaly-rows")
    model = _grow_forest(rows, columns, ids, trees, sample, seed)
    scored = written(rows.select(_score(model).alias("anomaly_raw")), "anomaly-scores")
    return model._replace(threshold=_threshold(scored, contamination))


def anomaly_scores(df: DataFrame, model: AnomalyModel) -> DataFrame:
    """Adds ``anomaly_raw`` (0..1, high is odd) and ``anomaly_score``: -1 odd, 1 normal."""
    return _label(df.withColumn("anomaly_raw", _score(model)), model.threshold)


def fit_anomaly_scores(df: DataFrame, columns: Sequence[str] = tuple(ANOMALY_FEATURES),
                       ids: Sequence[str] = (), contamination: float = 0.05, trees: int = 100,
                       sample: int = 256, seed: int = 42) -> DataFrame:
    """Train on ``df`` and label it, walking the trees once: the raw scores are written as a table,
    the cut is taken from their column and applied to them."""
    model = _grow_forest(df, columns, ids, trees, sample, seed)
    scored = written(df.withColumn("anomaly_raw", _score(model)), "anomaly-scores")
    return _label(scored, _threshold(scored, contamination))


# Scoring and model choice ---------------------------------------------------------------------------

def score_assets(features: DataFrame, regime: PipelineModel, anomaly: AnomalyModel, as_of: AsOf,
                 model_version: str = "champion/champion") -> DataFrame:
    """Scores of the latest date in the layout of the score table. The asset columns take the
    names of the daily means the classifier was trained on."""
    needed = list(dict.fromkeys([*ASSET_FEATURES, *ANOMALY_FEATURES]))
    rows = latest_snapshot(features, needed, ["asset_id", "symbol", "momentum_score"])
    rows = rows.withColumns({f"avg_{name}": F.col(name) for name in ASSET_FEATURES})
    predicted = regime.transform(rows)
    scored = anomaly_scores(predicted, anomaly).withColumns({
        "regime_confidence": F.array_max(vector_to_array("probability")),
        "scored_at": moment(as_of), "model_version": F.lit(model_version)})
    return conform(scored, schemas.GOLD_SCORES)


def champion(runs: DataFrame, minimum: float = 0.60) -> DataFrame:
    """Per model the newest version that passed the gate, and the one it replaced."""
    passed = runs.filter(F.col("cv_accuracy") >= minimum)
    spec = Window.partitionBy("model_name").orderBy(F.desc("trained_at"), F.desc("version"))
    newest = passed.withColumn("_rank", F.row_number().over(spec)).filter(F.col("_rank") <= 2)
    row = F.struct("version", "trained_at", "cv_accuracy", "path")
    return (newest.groupBy("model_name")
            .agg(F.max(F.when(F.col("_rank") == 1, row)).alias("c"),
                 F.max(F.when(F.col("_rank") == 2, F.col("version"))).alias("previous_version"))
            .select("model_name", "c.*", "previous_version"))
