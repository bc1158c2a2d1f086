"""Exact floor-rank percentile of an integer measure, without sorting rows in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_COARSE = 65_536


def p95_floor(df: DataFrame, by: Sequence[str], measure: str, share: float = 0.95) -> DataFrame:
    """Per group the value at index ``max(0, int(n * share) - 1)`` of the sorted measure.

    Rows are first counted per distinct value (combined map-side), so what travels is bounded by
    the integer domain, not by the rows of a group. The rank is then located in two steps:
    among at most 65,536 coarse ranges of the domain, and among at most 65,536 values of the
    one range that holds it. Null values do not count.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = (rows.filter(F.col(measure).isNotNull())
              .groupBy(*keys, F.col(measure).alias("_value"))
              .agg(F.count(F.lit(1)).alias("_n")))
    ranged = counts.withColumn("_range", F.floor(F.col("_value") / _COARSE).cast("long"))
    running = Window.partitionBy(*keys)
    coarse = (ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in_range"))
              .withColumn("_upto", F.sum("_in_range").over(running.orderBy("_range")))
              .withColumn("_rank", F.greatest(
                  F.lit(1), F.floor(F.sum("_in_range").over(running) * F.lit(share)))
                  .cast("long"))
              .filter((F.col("_upto") >= F.col("_rank"))
                      & (F.col("_upto") - F.col("_in_range") < F.col("_rank")))
              .select(*keys, "_range", "_rank",
                      (F.col("_upto") - F.col("_in_range")).alias("_before")))
    # null is a group like any other, so the join must meet it
    other = coarse.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
                          F.col("_range").alias("_r"), "_rank", "_before")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    fine = (ranged.join(other, same)
            .withColumn("_upto", F.col("_before")
                        + F.sum("_n").over(running.orderBy("_value")))
            .filter((F.col("_upto") >= F.col("_rank"))
                    & (F.col("_upto") - F.col("_n") < F.col("_rank"))))
    return fine.select(*by, F.col("_value").alias(f"p95_{measure}"))
