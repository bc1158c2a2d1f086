"""Market layer: snapshots, changes, dominance, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import cap_bucket, dominance_group, pct_change
from tidemark.operators.asof import DAY, asof_lookback
from tidemark.operators.latest import latest_version
from tidemark.schemas import MONEY


def market_base(bronze: DataFrame) -> DataFrame:
    """Latest version per (asset, time). The silver builders share it: compute it once."""
    rows = (bronze.filter(F.col("asset_id").isNotNull() & F.col("observed_at").isNotNull())
            .withColumn("observed_at", F.col("observed_at").cast("timestamp"))
            .withColumn("ingested_at", F.col("ingested_at").cast("timestamp")))
    return latest_version(rows, ["asset_id", "observed_at"], [
        F.col("ingested_at").desc(), F.col("source_record_id").desc()])


def silver_snapshots(bronze: DataFrame) -> DataFrame:
    return (market_base(bronze)
            .withColumn("symbol", F.upper("symbol"))
            .withColumn("name", F.coalesce("name", F.lit("unmapped")))
            .withColumn("category", F.coalesce("category", F.lit("unclassified"))))


def silver_changes(base: DataFrame, measure: T.DataType = MONEY,
                   slice_width: int = DAY) -> DataFrame:
    """Price change against 1 h, 24 h and 7 d ago. ``base`` comes from ``market_base``, so
    (asset, time) is unique and needs no further dedup."""
    rows = base.select("asset_id", "symbol", "name", "observed_at", "price_usd",
                       "volume_24h_usd", "market_cap_usd")
    looked = asof_lookback(rows, "asset_id", "observed_at", "price_usd",
                           {f"_ago_{w}": bounds for w, bounds in fv.CHANGE_WINDOWS.items()},
                           slice_width)
    return looked.select(
        "asset_id", F.upper("symbol").alias("symbol"), "name", "observed_at",
        F.to_date("observed_at").cast("string").alias("window_id"),
        *[pct_change("price_usd", f"_ago_{w}").cast(measure).alias(f"price_change_pct_{w}")
          for w in fv.CHANGE_WINDOWS],
        F.col("volume_24h_usd").cast(measure).alias("volume_24h_usd"),
        F.col("market_cap_usd").cast(measure).alias("market_cap_usd"))


def share_of_total(df: DataFrame, part: Sequence[str], group: Column, group_name: str,
                   measure: str, share_name: str) -> DataFrame:
    """Share of each group in its part, in percent; null where the total is zero.

    Groups are summed first (combined map-side), the total is a window over the few group rows; of
    a whole table (no ``part``) it is a one-row sum, as there may be many groups.
    """
    sums = df.groupBy(*part, group.alias(group_name)).agg(F.sum(measure).alias(measure))
    total = F.sum(measure).over(Window.partitionBy(*part))
    if not part:
        sums = sums.crossJoin(F.broadcast(sums.agg(F.sum(measure).alias("_total"))))
        total = F.col("_total")
        return sums.withColumn(share_name, F.when(total != 0, F.col(measure) / total * 100)).drop("_total")
    return sums.withColumn(share_name, F.when(total != 0, F.col(measure) / total * 100))


def silver_dominance(bronze: DataFrame, measure: T.DataType = MONEY) -> DataFrame:
    """Share of market cap per group and time. Rows without a valid cap are dropped before the
    latest version is chosen."""
    valid = bronze.filter(F.col("market_cap_usd") >= 0)
    base = market_base(valid).select(
        "observed_at", F.upper("symbol").alias("symbol"), "market_cap_usd")
    shares = share_of_total(base, ["observed_at"], dominance_group("symbol"), "dominance_group",
                            "market_cap_usd", "dominance_pct")
    return shares.select("observed_at", "dominance_group",
                         F.col("market_cap_usd").cast(measure).alias("market_cap_usd"),
                         F.col("dominance_pct").cast(measure).alias("dominance_pct"))


def silver_comparison(base: DataFrame, measure: T.DataType = MONEY,
                      slice_width: int = DAY) -> DataFrame:
    """Price, size and change of assets side by side, with narrower 24 h bounds than
    ``silver_changes`` and changes rounded to four digits."""
    rows = base.select("asset_id", F.upper("symbol").alias("symbol"), "observed_at",
                       "price_usd", "market_cap_usd", "volume_24h_usd", "market_cap_rank")
    looked = asof_lookback(rows, "asset_id", "observed_at", "price_usd",
                           {f"_ago_{w}": bounds for w, bounds in fv.COMPARISON_WINDOWS.items()},
                           slice_width)
    return looked.select(
        "asset_id", "symbol", "observed_at",
        *[F.col(name).cast(measure).alias(name)
          for name in ("price_usd", "market_cap_usd", "volume_24h_usd")],
        *[pct_change("price_usd", f"_ago_{w}", 4).cast(measure).alias(f"price_change_pct_{w}")
          for w in fv.COMPARISON_WINDOWS],
        cap_bucket("market_cap_rank").alias("correlation_bucket"))
