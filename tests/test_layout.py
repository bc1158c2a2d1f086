"""Curve layout, incremental silver and published tables."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import incremental
from tidemark.sources import layout, writers
from tidemark.sources.align import conform

START = datetime(2024, 1, 1)


def touched(path, column, low, high):
    """The share of files whose statistics let in a range."""
    files = [f for f in Path(path).glob("part-*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    inside = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        groups = [meta.row_group(g).column(meta.schema.names.index(column)).statistics for g in range(meta.num_row_groups)]
        inside += any(s.min <= high and s.max >= low for s in groups)
    return inside / len(files), len(files)


def test_either_column_skips_most_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(10_000), f"k{rng.randrange(10_000):05}", float(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a int, b string, x double")
    layout.write_curve(df, str(tmp_path / "curve"), ["a", "b"], files=64)
    writers.write_clustered(df.repartition(64), str(tmp_path / "sorted"), ["a", "b"])
    for column, name in (("a", lambda x: x), ("b", lambda x: f"k{x:05}")):
        shares = []
        for low in range(450, 10_000, 650):
            share, files = touched(tmp_path / "curve", column, name(low), name(low + 100))
            assert files >= 48 and share < 0.5  # the most where the curve jumps
            shares.append(share)
        assert sum(shares) / len(shares) <= 0.3
    assert touched(tmp_path / "sorted", "b", "k05000", "k05100")[0] > 0.9  # what one order cannot do
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "curve")).collect())) == sorted(rows)


def test_nulls_ties_hot_values_and_empty_tables(spark, tmp_path):
    rows = [(None, None, None, True)] * 5 + [(1, START, "hot", None)] * 300 + [(i, START + timedelta(days=i), "é" * (i % 9), i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, t timestamp, s string, f boolean")
    layout.write_curve(df, str(tmp_path / "odd"), ["t", "s", "f", "a"], files=8)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    layout.write_curve(df.limit(0), str(tmp_path / "none"), ["a", "t"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="order"):
        layout.write_curve(df.select(F.array("a").alias("l")), str(tmp_path / "bad"), ["l"])


def test_curve_interleaves_ranks(spark):
    row = spark.range(1).select(layout.curve([F.lit(5), F.lit(3)], 3).alias("z"), layout.rank("7.0D", [1.0, 7.0, 9.0]).alias("r"),
                                layout.rank("double(null)", [1.0]).alias("none")).first()
    assert row.z == int("100111", 2) and row.r == 2 and row.none == 0  # 101 and 011 in turn


def bronze(spark, rows):
    made = [(a, START + timedelta(hours=h), START + timedelta(hours=h, minutes=v), float(p)) for a, h, v, p in rows]
    df = spark.createDataFrame(made, "asset_id string, observed_at timestamp, ingested_at timestamp, price_usd double").withColumns(
        {"symbol": F.lit("btc"), "market_cap_usd": F.col("price_usd") * 10, "market_cap_rank": F.lit(1),
         "volume_24h_usd": F.lit(1.0), "source_record_id": F.concat_ws(":", "asset_id", "ingested_at")})
    return conform(df, schemas.BRONZE_MARKET)


def silver_of(spark, path):
    return {name: {} for name in incremental.TABLES} | {
        name: {r.asDict()[incremental.DAY]: sorted(map(str, rows)) for r, rows in days(spark, f"{path}/{name}")} for name in incremental.TABLES}


def days(spark, path):
    rows, found = spark.read.parquet(path).collect(), {}
    for row in rows:
        found.setdefault(row[incremental.DAY], []).append(row)
    return [(rows[0], rows) for rows in found.values()]


@pytest.mark.parametrize("late", [[("x", 24 * 5 + 3, 0, 50)], [("y", 24 * 9, 7, 99), ("new", 24 * 20 + 23, 0, 3)], [("x", 24 * 39 + 23, 0, 1)]])
def test_late_rows_change_the_days_that_see_them(spark, tmp_path, late):
    """Late rows, newer versions of old rows and rows at the end; a full rebuild is the measure."""
    rng = random.Random(2)
    rows = [(a, h, 0, rng.randint(1, 99)) for a in "xy" for h in range(0, 24 * 40) if h % 3 == 0 and not (a == "x" and h == 24 * 5 + 3)]
    one, whole = str(tmp_path / "one"), str(tmp_path / "whole")
    bronze(spark, rows).write.parquet(f"{one}/bronze")
    incremental.rebuild(spark, f"{one}/bronze", one)
    before = silver_of(spark, one)
    bronze(spark, late).write.mode("append").parquet(f"{one}/bronze")
    parts = incremental.refresh(spark, bronze(spark, late), f"{one}/bronze", one)
    after = silver_of(spark, one)
    incremental.rebuild(spark, f"{one}/bronze", whole)
    assert after == silver_of(spark, whole)
    for name, table in incremental.TABLES.items():
        changed = {d for d in after[name] if after[name][d] != before[name].get(d)}
        rebuilt = {first + timedelta(days=k) for first, last in parts[name] for k in range((last - first).days + 1)}
        assert changed and changed <= rebuilt and len(rebuilt) <= len(late) * (9 if table.reach else 1)
    incremental.refresh(spark, bronze(spark, late), f"{one}/bronze", one)
    assert silver_of(spark, one) == after


def test_days_that_see_a_row():
    d = date(2024, 1, 10)
    assert incremental.spans([d], 0) == [(d, d)]
    assert incremental.spans([d], 1) == [(d, d + timedelta(days=1))]
    assert incremental.spans([d], 24 * 60) == [(d, d + timedelta(days=1))]
    assert incremental.spans([d], 24 * 60 + 1) == [(d, d + timedelta(days=2))]
    assert incremental.spans([d, d + timedelta(days=2), d - timedelta(days=30)], 60) == [
        (d - timedelta(days=30), d - timedelta(days=29)), (d, d + timedelta(days=3))]


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    assert set(map(tuple, incremental.refresh(spark, bronze(spark, [("x", 1, 0, 1)]).limit(0), "none", str(tmp_path)).values())) == {()}


def test_published_tables_keep_old_rows_until_the_last_statement(spark, tmp_path, monkeypatch):
    name, folder = "published_prices", str(tmp_path / "prices")
    writers.publish_table(spark.range(3).withColumn("p", F.lit(1)), name, folder)
    old = spark.table(name)
    assert old.count() == 3

    def broken(*args):
        raise RuntimeError("stopped before the statement")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", broken)
        patch.setattr(type(spark.catalog), "createTable", broken)
        with pytest.raises(RuntimeError):
            writers.publish_table(spark.table(name).withColumn("p", F.lit(2)), name, folder)
    spark.catalog.refreshTable(name)
    assert sorted(map(tuple, spark.table(name).collect())) == [(0, 1), (1, 1), (2, 1)]
    writers.publish_table(spark.table(name).withColumn("p", F.col("p") + 1), name, folder)
    assert sorted(map(tuple, spark.table(name).collect())) == [(0, 2), (1, 2), (2, 2)]
    writers.publish_table(spark.range(1), name, folder)  # another schema
    assert spark.table(name).columns == ["id"]
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TEMP VIEW {name} AS SELECT 1 AS one")
    writers.publish_table(spark.range(2), name, folder)
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_latest_versions_are_found_once_for_tables_that_share_them(spark, tmp_path, monkeypatch):
    """One pass for changes and comparison and one for dominance; tables are as their builders give them."""
    from tidemark.operators import silver
    rows = bronze(spark, [("btc", 1, 0, 1), ("btc", 1, 0, 2), ("eth", 2, 5, 1), ("btc", 8, 0, 1), ("eth", 9, 5, 3), ("eth", 2, 5, 4)])
    rows.write.parquet(f"{tmp_path}/bronze")
    found, find = [], silver.market_base
    monkeypatch.setattr(silver, "market_base", lambda df: found.append(1) or find(df))
    incremental.rebuild(spark, f"{tmp_path}/bronze", str(tmp_path))
    assert len(found) == 2
    for name, build in (("silver_market_changes", silver.silver_changes), ("silver_cross_asset_comparison", silver.silver_comparison)):
        want = build(find(rows))
        got = incremental.read_silver(spark, str(tmp_path), name).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
