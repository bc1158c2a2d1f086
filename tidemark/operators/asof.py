"""As-of lookback: the latest earlier value whose age lies in a window.

Design for hot keys and dense series. A range self-join emits every pair inside the window and a
RANGE frame walks the whole frame again for each row; both grow with (rows per window) squared.
Here every row is sent once as a *target* and once per window as a *candidate* that becomes
visible at ``ts + nearest``. Sorted by the moment of visibility, the answer is the last candidate
seen so far, kept if it is not older than ``farthest``: one shuffle, one sort, one linear pass for
all windows together.

Time is cut into slices and (key, slice) is the shuffle key, so the history of one key spreads
over many tasks. A candidate is copied to the slices its visibility interval touches (two at most
for windows shorter than a slice), which keeps the result exact at the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MINUTE = 60_000_000  # microseconds
DAY = 1440 * _MINUTE

Windows = Mapping[str, tuple[float, float]]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _slice(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def _candidate_copies(t: Column, kind: int, near: int, far: int, width: int) -> list[Column]:
    """One struct per slice the candidate is visible in; those beyond its last slice are null.
    Plain conditionals instead of an array function keep the expression in generated code."""
    first, last = _slice(t + F.lit(near), width), _slice(t + F.lit(far), width)
    at = (t + F.lit(near)).alias("at")
    return [F.when(first + step <= last, F.struct(
        (first + step).alias("slice"), F.lit(kind).alias("kind"), at))
        for step in range((far - near) // width + 2)]


def _resolve(marked: DataFrame, keys: Sequence[str], bounds: Sequence[tuple[str, int]],
             values: Sequence[str], names: Mapping[tuple[str, str], str]) -> DataFrame:
    """Run the linear pass over targets and candidates and unpack the targets."""
    target_kind = len(bounds)
    order = (Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_slice")
             .orderBy("_at", "_kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marked.select(
        "_kind", "_at", "_target",
        *[F.last(F.when(F.col("_kind") == kind, F.col("_hit")), ignorenulls=True)
          .over(order).alias(f"_hit{kind}") for kind in range(target_kind)])
    picked = []
    for kind, (name, far) in enumerate(bounds):
        hit = F.col(f"_hit{kind}")
        fresh = F.col("_at") - hit["t"] <= F.lit(far)
        picked += [F.when(fresh, hit[value]).alias(names[name, value]) for value in values]
    return found.filter(F.col("_kind") == target_kind).select("_target.*", *picked)


def _bounds(windows: Windows) -> list[tuple[str, int, int]]:
    return [(name, int(near * _MINUTE), int(far * _MINUTE))
            for name, (near, far) in windows.items()]


def asof_lookback(df: DataFrame, key: str | Sequence[str], ts: str, value: str,
                  windows: Windows, slice_width: int = DAY) -> DataFrame:
    """Add one column per window: ``value`` of the latest row of the same key whose age in
    minutes lies in ``[nearest, farthest]``, both inclusive.

    (key, ts) must be unique. A null value at the chosen row stays null; null keys match nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    bounds = _bounds(windows)
    t = F.col("_t")
    copies = [F.struct(_slice(t, slice_width).alias("slice"), F.lit(len(bounds)).alias("kind"),
                       t.alias("at"))]
    for kind, (_, near, far) in enumerate(bounds):
        copies += _candidate_copies(t, kind, near, far, slice_width)
    is_target = F.col("_copy.kind") == len(bounds)
    known = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in keys])
    marked = (
        df.withColumn("_t", _micros(F.col(ts)))
        .withColumn("_copy", F.explode(F.array(*copies)))
        .filter(F.col("_copy").isNotNull() & (is_target | known))
        .select(
            *[F.col(name).alias(f"_k{i}") for i, name in enumerate(keys)],
            F.col("_copy.slice").alias("_slice"), F.col("_copy.kind").alias("_kind"),
            F.col("_copy.at").alias("_at"),
            F.when(is_target, F.struct(*df.columns)).alias("_target"),
            F.when(~is_target, F.struct(t.alias("t"), F.col(value).alias(value))).alias("_hit")))
    return _resolve(marked, keys, [(name, far) for name, _, far in bounds], [value],
                    {(name, value): name for name in windows})


def asof_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], left_ts: str,
              right_ts: str, values: Sequence[str], nearest: float = 0,
              farthest: float = 1440, slice_width: int = DAY) -> DataFrame:
    """Two-table form: for each left row the ``values`` of the latest right row of the key whose
    age in minutes lies in ``[nearest, farthest]``. (key, right_ts) must be unique."""
    keys = [key] if isinstance(key, str) else list(key)
    near, far = int(nearest * _MINUTE), int(farthest * _MINUTE)
    t = F.col("_t")
    keyed = [F.col(name).alias(f"_k{i}") for i, name in enumerate(keys)]
    hit = F.struct(t.alias("t"), *values)
    candidates = (
        right.na.drop(subset=keys).withColumn("_t", _micros(F.col(right_ts)))
        .withColumn("_copy", F.explode(F.array(*_candidate_copies(t, 0, near, far, slice_width))))
        .filter("_copy IS NOT NULL")
        .select(*keyed, F.col("_copy.slice").alias("_slice"), F.lit(0).alias("_kind"),
                F.col("_copy.at").alias("_at"), hit.alias("_hit")))
    targets = (
        left.withColumn("_t", _micros(F.col(left_ts)))
        .select(*keyed, _slice(t, slice_width).alias("_slice"), F.lit(1).alias("_kind"),
                t.alias("_at"), F.struct(*left.columns).alias("_target")))
    marked = targets.unionByName(candidates, allowMissingColumns=True)
    return _resolve(marked, keys, [("right", far)], list(values),
                    {("right", value): value for value in values})
