from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators import asof, enrich, freshness, gold, latest, silver
from tests.conftest import dicts

BRONZE = ("asset_id string, symbol string, name string, category string, observed_at timestamp, "
          "ingested_at timestamp, source_record_id string, price_usd double, "
          "market_cap_usd double, volume_24h_usd double, circulating_supply double, "
          "market_cap_rank long")


def row(asset, observed, price, *, symbol="btc", ingested=None, record="r", cap=100.0, rank=1,
        name="n", volume=5.0):
    return (asset, symbol, name, None, observed, ingested or observed, record, price, cap, volume,
            1.0, rank)


def at(minutes):
    return str(datetime(2024, 1, 10, 12) + timedelta(minutes=minutes))


def test_latest_version_prefers_ingested_then_record(frame):
    df = frame(BRONZE, row("a", at(0), 1.0, record="1"), row("a", at(0), 2.0, record="2"),
               row("a", at(0), 3.0, ingested=at(-9), record="9"), row(None, at(0), 4.0))
    assert [r["price_usd"] for r in dicts(silver.market_base(df))] == [2.0]


@pytest.mark.parametrize("age, hit", [(55, True), (65, True), (66, False), (54, False)])
def test_lookback_bounds_are_inclusive(frame, age, hit):
    df = frame("k string, ts timestamp, v double", ("a", at(-age), 7.0), ("a", at(0), 8.0))
    rows = dicts(asof.asof_lookback(df, "k", "ts", "v", {"ago": (55, 65)}))
    assert [r["ago"] for r in rows if r["v"] == 8.0] == [7.0 if hit else None]


def test_lookback_takes_the_latest_and_keeps_its_null(frame):
    df = frame("k string, ts timestamp, v double", ("a", at(-64), 1.0), ("a", at(-56), 2.0),
               ("a", at(0), 3.0), ("b", at(-64), 1.0), ("b", at(-56), None), ("b", at(0), 4.0))
    rows = dicts(asof.asof_lookback(df, "k", "ts", "v", {"ago": (55, 65)}))
    assert {r["v"]: r["ago"] for r in rows if r["v"] in (3.0, 4.0)} == {3.0: 2.0, 4.0: None}


@pytest.mark.parametrize("slice_minutes", [30, 240, 1440, 100_000])
def test_lookback_equals_brute_force_whatever_the_slices(spark, slice_minutes):
    import random
    rng = random.Random(slice_minutes)
    start = datetime(2024, 1, 1)
    # one hot key with most of the rows, a few cold ones
    rows = {(rng.choice("hhhhhhabc"), start + timedelta(minutes=rng.randint(0, 3000)))
            for _ in range(400)}
    rows = [(k, ts, float(i)) for i, (k, ts) in enumerate(sorted(rows))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    windows = {"near": (0.5, 20), "mid": (55, 65), "far": (1380, 1500)}
    got = {(r["k"], r["ts"]): (r["near"], r["mid"], r["far"]) for r in dicts(asof.asof_lookback(
        df, "k", "ts", "v", windows, slice_minutes * 60_000_000))}
    assert len(got) == len(rows)
    for k, ts, _ in rows:
        for i, (near, far) in enumerate(windows.values()):
            fits = [(t, v) for key, t, v in rows if key == k
                    and timedelta(minutes=near) <= ts - t <= timedelta(minutes=far)]
            assert got[k, ts][i] == (max(fits)[1] if fits else None)


def test_null_keys_match_nothing_and_stay(frame):
    df = frame("k string, ts timestamp, v double", (None, at(-60), 1.0), (None, at(0), 2.0))
    rows = dicts(asof.asof_lookback(df, "k", "ts", "v", {"ago": (55, 65)}))
    assert [r["ago"] for r in rows] == [None, None]
    assert [r["p"] for r in dicts(asof.asof_join(
        df, df.withColumnRenamed("v", "p"), "k", "ts", "ts", ["p"], 0, 90))] == [None, None]


def test_asof_join_of_two_tables(frame):
    left = frame("k string, ts timestamp, id int", ("a", at(0), 1), ("a", at(100), 2), ("z", at(0), 3))
    right = frame("k string, ts timestamp, p double", ("a", at(-10), 1.0), ("a", at(0), 2.0),
                  ("a", at(50), 3.0))
    rows = dicts(asof.asof_join(left, right, "k", "ts", "ts", ["p"], 0, 60))
    assert {r["id"]: r["p"] for r in rows} == {1: 2.0, 2: 3.0, 3: None}


def test_changes_in_decimals(spark, frame):
    df = frame(BRONZE, row("a", at(0), 110.0), row("a", at(-60), 100.0), row("a", at(-1440), 0.0))
    money = df.withColumn("price_usd", F.col("price_usd").cast(schemas.MONEY))
    out = silver.silver_changes(silver.market_base(money))
    assert out.schema["price_change_pct_1h"].dataType == T.DecimalType(38, 8)
    now = [r for r in dicts(out) if float(r["market_cap_usd"]) == 100.0 and r["price_change_pct_1h"]]
    assert len(now) == 1 and float(now[0]["price_change_pct_1h"]) == 10.0
    assert now[0]["price_change_pct_24h"] is None  # base price 0
    assert now[0]["window_id"] == "2024-01-10" and now[0]["symbol"] == "BTC"


def test_dominance_shares(frame):
    df = frame(BRONZE, row("1", at(0), 1.0, symbol="btc", cap=60.0),
               row("2", at(0), 1.0, symbol="eth", cap=20.0),
               row("3", at(0), 1.0, symbol="usdc", cap=10.0),
               row("4", at(0), 1.0, symbol="xyz", cap=10.0),
               row("5", at(0), 1.0, symbol="bad", cap=-5.0),
               row("6", at(0), 1.0, symbol="none", cap=None),
               row("7", at(60), 1.0, symbol="btc", cap=0.0))
    rows = dicts(silver.silver_dominance(df, T.DoubleType()))
    first = {r["dominance_group"]: r["dominance_pct"] for r in rows if r["market_cap_usd"]}
    assert first == {"btc": 60.0, "eth": 20.0, "stablecoins": 10.0, "long_tail": 10.0}
    assert [r["dominance_pct"] for r in rows if not r["market_cap_usd"]] == [None]


def test_dominance_adds_up_to_100(spark):
    from tidemark.workload.views import Views
    total = (Views(spark, "/root/testdata/sf0.001").dominance.groupBy("observed_at")
             .agg(F.sum("dominance_pct").alias("s")).filter("s IS NOT NULL"))
    assert total.filter(F.abs(F.col("s") - 100) > 1e-6).count() == 0


def test_movers_quality_and_bands(frame):
    df = frame("asset_id string, symbol string, name string, observed_at timestamp, window_id string,"
               "price_change_pct_1h double, price_change_pct_24h double, price_change_pct_7d double,"
               "volume_24h_usd double, market_cap_usd double",
               ("a", "A", None, at(0), "d", None, 25.0, 1.0, 1.0, 1.0),
               ("b", "B", "b", at(0), "d", 1.0, -5.0, 1.0, 1.0, 1.0),
               ("c", "C", "c", at(0), "d", 1.0, 0.0, 501.0, 1.0, 1.0))
    rows = {r["asset_id"]: r for r in dicts(gold.gold_movers(df))}
    assert [rows[k]["quality_status"] for k in "abc"] == ["review", "pass", "review"]
    assert [rows[k]["move_direction_24h"] for k in "abc"] == ["positive", "negative", "flat"]
    assert [rows[k]["move_band_24h"] for k in "abc"] == ["high", "medium", "low"]
    assert rows["a"]["name"] == "unmapped"


def test_rankings_dedup_and_null_measure(frame):
    df = frame(BRONZE, row("a", at(0), 1.0, rank=2), row("a", at(0), 2.0, rank=1),
               row("b", at(0), None, rank=3), row("c", at(0), 1.0, rank=None))
    rows = {r["asset_id"]: r for r in dicts(gold.gold_rankings(df))}
    assert set(rows) == {"a", "b"} and rows["a"]["price_usd"] == 2.0
    assert rows["b"]["quality_status"] == "review"


def test_freshness_and_quality_of_an_empty_table(frame):
    empty = frame(BRONZE)
    rankings = gold.gold_rankings(empty)
    watch = {"t": freshness.Watch(rankings, "observed_at", "tier_a", 15)}
    rules = {"t": freshness.QualityRules(rankings, ["asset_id", "observed_at"], ["asset_id"],
                                         F.col("price_usd") < 0)}
    f, q = freshness.freshness_status(watch, at(0)), freshness.quality_status(rules)
    assert dicts(f)[0]["freshness_status"] == "missing"
    quality = dicts(q)[0]
    assert quality["quality_status"] == "review" and quality["row_count"] == 0
    assert quality["critical_null_rows"] is None
    served = dicts(freshness.serving_readiness(q, f))
    assert served == dicts(freshness.serving_in_one_pass(watch, rules, at(0)).select(*served[0]))
    assert served[0]["serving_status"] == "hold"


def test_quality_counts_duplicates(frame):
    df = frame("k string, v double", ("a", 1.0), ("a", -1.0), ("b", 2.0), (None, 1.0))
    rules = {"t": freshness.QualityRules(df, ["k"], ["k"], F.col("v") < 0)}
    got = dicts(freshness.quality_status(rules))[0]
    assert (got["row_count"], got["duplicate_key_rows"], got["critical_null_rows"],
            got["numeric_outlier_rows"], got["quality_status"]) == (4, 1, 1, 1, "review")


def test_freshness_edges(frame):
    df = frame("ts timestamp", (at(0),))
    status = lambda minutes: dicts(freshness.freshness_status(
        {"t": freshness.Watch(df, "ts", "tier_a", 15)}, at(minutes)))[0]
    assert status(15)["freshness_status"] == "within_target"
    assert status(16)["freshness_status"] == "stale" and status(16)["freshness_age_minutes"] == 16


def test_enrichment_ignores_case_and_prefers_latest(frame):
    snaps = frame(BRONZE, row("Uni", at(0), 1.0), row("Uni", at(5), 2.0), row("solo", at(0), 3.0))
    protocols = frame("source_record_id string, protocol_slug string, category string, tvl_usd double,"
                      "fees_24h_usd double, revenue_24h_usd double, mcap_tvl_ratio double,"
                      "observed_at timestamp, ingested_at timestamp",
                      ("uni", "old", "dex", 1.0, 1.0, 1.0, 1.0, at(0), at(0)),
                      ("uni", "new", "dex", 9.0, 1.0, 1.0, 1.0, at(9), at(9)))
    repos = frame("asset_id string, repo_full_name string, stars long, forks long, open_issues long,"
                  "contributors_count long, commits_30d long, commits_90d long, repo_age_days long,"
                  "observed_at timestamp, ingested_at timestamp",
                  ("UNI", "o/r", 500, 1, 1, 1, 6, 9, 10, at(0), at(0)))
    rows = {r["asset_id"]: r for r in dicts(enrich.asset_enriched(snaps, protocols, repos, at(9)))}
    assert rows["Uni"]["protocol_slug"] == "new" and rows["Uni"]["price_usd"] == 2.0
    assert rows["Uni"]["dev_activity_score"] == 17
    assert rows["solo"]["dev_activity_score"] == 0 and rows["solo"]["tvl_usd"] is None
    assert dicts(gold.gold_protocols(enrich.asset_enriched(snaps, protocols, repos, at(9))))[0][
        "asset_id"] == "Uni"


def test_macro_context(frame):
    df = frame("series_id string, series_name string, observation_date string, value double,"
               "ingested_at timestamp, source_record_id string",
               ("A", "a", "2024-01-09", 12.0, at(0), "1"), ("A", "a", "2023-12-01", 10.0, at(0), "2"),
               ("A", "a", "2023-11-01", 1.0, at(0), "3"), ("B", "b", "2024-01-09", 5.0, at(0), "4"),
               ("C", "c", "2024-01-09", 5.0, at(0), "5"), ("C", "c", "2023-10-01", 0.0, at(0), "6"))
    rows = {r["series_id"]: r for r in dicts(enrich.macro_context(df, at(0)))}
    assert rows["A"]["change_30d_pct"] == 20.0 and rows["A"]["value_30d_ago"] == 10.0
    assert rows["B"]["value_30d_ago"] is None and rows["B"]["change_30d_pct"] is None
    assert rows["C"]["value_30d_ago"] == 0.0 and rows["C"]["change_30d_pct"] is None


def test_features_use_the_latest_btc_row_of_the_hour(frame):
    changes = frame("asset_id string, symbol string, observed_at timestamp, price_change_pct_24h double,"
                    "price_change_pct_7d double, volume_24h_usd double, market_cap_usd double",
                    ("a", "A", at(5), 10.0, 5.0, 500.0, 1000.0), ("a", "A", at(-99999), 1.0, 1.0, 1.0, 1.0))
    dominance = frame("observed_at timestamp, dominance_group string, dominance_pct double",
                      (at(1), "btc", 40.0), (at(30), "btc", 41.0), (at(1), "eth", 9.0))
    rows = dicts(enrich.market_features(changes, dominance, at(60)))
    assert len(rows) == 1 and rows[0]["dominance_pct_btc"] == 41.0
    assert rows[0]["momentum_score"] == 7.0 and rows[0]["vol_to_cap_ratio"] == 0.5
    assert len(dicts(enrich.market_features(changes, dominance, at(60), every_btc_row=True))) == 2


def test_dedup_batch_without_order_is_deterministic(frame):
    df = frame("source_system string, source_record_id string, v int", ("s", "1", 1), ("s", "1", 3),
               ("s", "1", 2), ("s", "2", 5))
    assert sorted(r["v"] for r in dicts(latest.dedup_batch(df))) == [3, 5]
