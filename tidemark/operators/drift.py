"""Label distributions, population stability and the alerts built on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import before, moment
from tidemark.operators.silver import share_of_total
from tidemark.sources.align import conform

AsOf = datetime | str | Column
FLOOR, TINY = 0.001, 1e-9


def label_counts(scores: DataFrame, label: str = "predicted_regime", ts: str = "scored_at") -> DataFrame:
    """Rows per time and label. A scoring run has one time, so this is a row per run and label; the counts of
    several runs are read together as if they were their score rows."""
    return scores.groupBy(ts, label).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(scores: DataFrame, low: Column | None = None, high: Column | None = None,
                       label: str = "predicted_regime", ts: str = "scored_at", weight: str | None = None) -> DataFrame:
    """Share per label among the rows with ``low <= ts < high``; no rows, no labels. ``weight`` names the column
    that tells for how many rows a row stands (``n`` of ``label_counts``)."""
    rows = scores
    if low is not None:
        rows = rows.filter(F.col(ts) >= low)
    if high is not None:
        rows = rows.filter(F.col(ts) < high)
    rows = rows.select(F.coalesce(F.col(label).cast("string"), F.lit("None")).alias("_label"),
                       (F.col(weight) if weight else F.lit(1)).alias("n"))
    shares = share_of_total(rows, [], F.col("_label"), "label", "n", "pct")
    return shares.select("label", (F.col("pct") / 100).alias("share"))


def psi(base: DataFrame, current: DataFrame) -> DataFrame:
    """One row: population stability index over the union of labels, 0 if a side is empty."""
    sides = base.select("label", F.col("share").alias("e")).join(
        current.select("label", F.col("share").alias("a")), "label", "full")
    floored = lambda name: F.greatest(F.coalesce(name, F.lit(FLOOR)), F.lit(TINY))
    e, a = floored("e"), floored("a")
    both = (F.count("e") > 0) & (F.count("a") > 0)
    return sides.agg(F.when(both, F.round(F.sum((a - e) * F.log(a / e)), 6)).otherwise(0.0)
                     .alias("psi"))


def _log_rows(df: DataFrame, as_of: AsOf, source: str) -> DataFrame:
    return conform(df.withColumn("source", F.lit(source))
                   .withColumn("created_at", moment(as_of)), schemas.ALERTS)


def _windows(scores: DataFrame, as_of: AsOf, weight: str | None) -> tuple[DataFrame, DataFrame]:
    day = before(as_of, days=1)
    return (label_distribution(scores, before(as_of, days=7), day, weight=weight),
            label_distribution(scores, day, weight=weight))


def drift_psi(scores: DataFrame, as_of: AsOf, weight: str | None = None) -> DataFrame:
    """Last 24 hours against the six days before them, of score rows or (with ``weight``) of their counts."""
    return psi(*_windows(scores, as_of, weight))


def _listed(shares: DataFrame, name: str) -> DataFrame:
    """One row: the distribution as text, labels in order (a handful of labels)."""
    entry = F.format_string("'%s': %s", F.col("label"), F.col("share").cast("string"))
    return shares.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ", "),
                               F.lit("}")).alias(name))


def drift_alert(scores: DataFrame, as_of: AsOf, threshold: float = 0.2,
                source: str = fv.DRIFT_SOURCE, weight: str | None = None) -> DataFrame:
    """At most one alert row, ready to append. Needs the score history (or, with ``weight``, its counts), not the
    merged table."""
    base, current = _windows(scores, as_of, weight)
    found = (psi(base, current).crossJoin(F.broadcast(_listed(current, "now")))
             .crossJoin(F.broadcast(_listed(base, "past"))).filter(F.col("psi") >= threshold))
    return _log_rows(found.select(
        F.lit("model_drift").alias("kind"),
        F.format_string(fv.DRIFT_MESSAGE, "psi", F.lit(str(threshold)), "now", "past").alias("message")),
        as_of, source)


def retrain_trigger(alerts: DataFrame, as_of: AsOf, days: int = 3, times: int = 3,
                    source: str = fv.DRIFT_SOURCE) -> DataFrame:
    """One row when drift was reported ``times`` times within ``days``."""
    breaches = alerts.filter((F.col("kind") == "model_drift")
                             & (F.col("created_at") >= before(as_of, days=days)))
    return _log_rows(breaches.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times).select(
        F.lit("retrain_trigger").alias("kind"),
        F.format_string(fv.RETRAIN_MESSAGE, "n", F.lit(days)).alias("message")),
        as_of, source)
