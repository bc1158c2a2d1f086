"""Silver by day, refreshed only where new bronze rows can be seen.

A row seen at a time changes rows of silver at that time and at later times that look back to it. So the
touched days of a batch and the reach of each table give the days to rebuild; bronze is read for these
and for what they look back to, and only their partitions are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime, time, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fv
from tidemark.operators import silver
from tidemark.schemas import MONEY
from tidemark.session import written
from tidemark.sources import writers

DAY = "observed_day"  # the partition column
MOST_DAYS = 100_000  # of a batch, which the driver lists


class Table(NamedTuple):
    """How a silver table follows from bronze, or from its latest versions, and how many minutes it looks back."""

    build: Callable[[DataFrame, T.DataType], DataFrame]
    reach: int
    latest: bool = False


def _reach(windows: dict[str, tuple[int, int]]) -> int:
    return max(high for _, high in windows.values())


TABLES = {
    "silver_market_changes": Table(silver.silver_changes, _reach(fv.CHANGE_WINDOWS), latest=True),
    "silver_market_dominance": Table(silver.silver_dominance, 0),
    "silver_cross_asset_comparison": Table(silver.silver_comparison, _reach(fv.COMPARISON_WINDOWS), latest=True)}
# Of the latest versions, what these tables are built from.
LATEST_COLUMNS = ["asset_id", "symbol", "name", "observed_at", "price_usd", "volume_24h_usd", "market_cap_usd", "market_cap_rank"]

Spans = list[tuple[date, date]]


def day_of(column: str = "observed_at") -> Column:
    return F.to_date(F.col(column).cast("timestamp"))


def touched_days(batch: DataFrame) -> list[date]:
    """The days on which ``batch`` has rows, one entry per day; rows without a time reach no table."""
    days = batch.select(day_of().alias("day")).filter("day IS NOT NULL").distinct().limit(MOST_DAYS + 1).collect()
    if len(days) > MOST_DAYS:
        raise ValueError(f"the batch has rows on more than {MOST_DAYS} days; rebuild the tables instead")
    return sorted(r.day for r in days)


def spans(days: Iterable[date], reach: int) -> Spans:
    """First and last days, both included and apart from each other, of the rows that see a row of ``days``."""
    later = timedelta(days=(24 * 60 + reach - 1) // (24 * 60))
    found: Spans = []
    for day in sorted(days):
        if found and day <= found[-1][1] + timedelta(days=1):
            found[-1] = (found[-1][0], max(found[-1][1], day + later))
        else:
            found.append((day, day + later))
    return found


def _within(column: Column, parts: Spans, before: int = 0) -> Column:
    """Times in the days of ``parts``, and up to ``before`` minutes ahead of them; comparisons that reach the scan."""
    def one(first: date, last: date) -> Column:
        low = datetime.combine(first, time()) - timedelta(minutes=before)
        high = datetime.combine(last + timedelta(days=1), time())
        return (column >= F.lit(f"{low}").cast("timestamp")) & (column < F.lit(f"{high}").cast("timestamp"))

    return reduce(Column.__or__, [one(*part) for part in parts])


def rebuild(spark: SparkSession, bronze_path: str, silver_path: str, parts: dict[str, Spans] | None = None,
            measure: T.DataType = MONEY) -> None:
    """Write the days ``parts`` names of each table (all days without it) from bronze; others stay as they are.

    Latest versions are found once for all tables that are built from them and see the same bronze rows: they are
    written as a table below the shared folder, as each table would sort bronze for them again."""
    bronze = spark.read.parquet(bronze_path)
    seen = F.col("observed_at")
    held: dict[tuple, DataFrame] = {}

    def source(table: Table, days: Spans | None) -> DataFrame:
        rows = bronze if days is None else bronze.filter(_within(seen, days, table.reach))
        if not table.latest:
            return rows
        same = () if days is None else (table.reach, *days)
        if same not in held:
            held[same] = written(silver.market_base(rows).select(*LATEST_COLUMNS), "latest-versions")
        return held[same]

    for name, table in TABLES.items():
        if parts is None:
            rows = table.build(source(table, None), measure)
        elif parts.get(name):
            rows = table.build(source(table, parts[name]), measure).filter(_within(seen, parts[name]))
        else:
            continue
        writers.overwrite_partitioned(rows.withColumn(DAY, day_of()), f"{silver_path}/{name}", [DAY])


def refresh(spark: SparkSession, batch: DataFrame, bronze_path: str, silver_path: str, measure: T.DataType = MONEY
            ) -> dict[str, Spans]:
    """Bring silver up to date after the rows of ``batch`` have been added to bronze; returns the days rebuilt.

    The result equals a full ``rebuild``: late rows and newer versions of old rows too change every day that
    sees them. An empty batch changes nothing, and the same batch again gives the same tables."""
    days = touched_days(batch)
    parts = {name: spans(days, table.reach) for name, table in TABLES.items()}
    if days:
        rebuild(spark, bronze_path, silver_path, parts, measure)
    return parts


def read_silver(spark: SparkSession, silver_path: str, name: str) -> DataFrame:
    """A table's rows without the partition column."""
    return spark.read.parquet(f"{silver_path}/{name}").drop(DAY)
