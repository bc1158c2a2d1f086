import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import moment
from tidemark.operators import validate
from tidemark.plans import batch
from tidemark.sources import align, readers, writers
from tests.conftest import dicts

NOW = "2024-01-31 00:00:00"
ETH = {"id": "ethereum", "symbol": "eth", "market_cap": "1000", "current_price": "3200",
       "total_volume": 5, "circulating_supply": 1, "market_cap_rank": "2",
       "last_updated": "2024-01-30T10:00:00Z"}


def feed(spark, schema, *rows):
    texts = [json.dumps(row) for row in rows]
    return spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.from_json("t", schema).alias("r")).select("r.*")


def checked(spark, *rows):
    return validate.validate_market(validate.normalize_market(
        feed(spark, schemas.MARKET_FEED, *rows), moment(NOW)))


def test_market_aliases_and_defaults(spark):
    got = dicts(align.to_bronze_market(checked(spark, ETH).good))[0]
    assert got["asset_id"] == "ethereum" and got["symbol"] == "ETH" and got["market_cap_rank"] == 2
    assert float(got["price_usd"]) == 3200.0 and got["source_system"] == fv.DEFAULT_SOURCE_SYSTEM
    assert got["name"] == "unmapped" and got["category"] == "unclassified"
    assert got["source_record_id"] == "ethereum:2024-01-30T10:00:00Z"


@pytest.mark.parametrize("change, reason", [
    ({"source_system": "unsupported"}, "unsupported:source_system"),
    ({"symbol": ""}, "missing:symbol"), ({"id": None}, "missing:asset_id"),
    ({"current_price": "n/a"}, "invalid:price_usd"), ({"market_cap_rank": "two"}, "invalid:market_cap_rank"),
    ({"market_cap_usd": ""}, "missing:market_cap_usd"), ({"last_updated": "soon"}, "invalid:observed_at")])
def test_bad_market_rows_are_quarantined_with_reasons(spark, change, reason):
    result = checked(spark, {**ETH, **change}, ETH)
    assert result.good.count() == 1
    assert reason in dicts(result.quarantine)[0]["reasons"]


def test_payload_object_array_and_nothing(spark, tmp_path):
    one, many, odd = tmp_path / "one.json", tmp_path / "many.json", tmp_path / "odd.json"
    one.write_text(json.dumps(ETH)), many.write_text(json.dumps([ETH, ETH]))
    odd.write_text('"text"')
    read = lambda path: readers.read_payload(spark, path and str(path), schemas.MARKET_FEED)
    assert (read(one).count(), len(read(many).collect()), read(None).count()) == (1, 2, 0)
    with pytest.raises(Exception):
        read(odd).collect()


def test_unreadable_lines_arrive_as_rejects(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps(ETH) + "\n{broken\n")
    rows = dicts(readers.read_payload_with_rejects(spark, str(path), schemas.MARKET_FEED))
    assert sorted(r[readers.CORRUPT] or "" for r in rows) == ["", "{broken"]


def test_protocols(spark):
    rows = dicts(validate.normalize_protocols(feed(
        spark, schemas.PROTOCOL_FEED,
        {"slug": "aave", "tvl": 3.5e9, "mcap": 7e9, "fees": 0, "feesHistory": [1, 2.5], "chain": "eth"},
        {"name": "Big Pool", "tvl": "10", "chains": ["base", "eth"], "revenue": 4},
        {"slug": "x", "tvl": "n/a"}, {"slug": "y"}, {"tvl": 1}), moment(NOW)))
    assert len(rows) == 2
    aave, pool = rows
    assert aave["mcap_tvl_ratio"] == 2.0 and aave["fees_24h_usd"] == 2.5 and aave["chain"] == "eth"
    assert pool["protocol_slug"] == "big-pool" and pool["chain"] == "base"
    assert pool["revenue_24h_usd"] == 4.0 and pool["mcap_tvl_ratio"] is None


def test_protocol_chain_quirk_is_optional(spark):
    row = feed(spark, schemas.PROTOCOL_FEED, {"slug": "a", "tvl": 1, "chain": "eth"})
    chain = lambda strict: dicts(validate.normalize_protocols(row, moment(NOW), strict))[0]["chain"]
    assert (chain(False), chain(True)) == ("eth", "unknown")


def test_macro_observations(spark):
    df = feed(spark, schemas.MACRO_FEED, {"series_id": "DGS10", "observations": [
        {"date": "2024-01-01", "value": "4.1"}, {"date": "2024-01-02", "value": "."},
        {"date": "", "value": "1"}, {"date": "2024-01-03", "value": "x"}]})
    rows = dicts(validate.normalize_observations(df, readers.series_names(spark), moment(NOW)))
    assert [(r["source_record_id"], r["value"], r["series_name"]) for r in rows] == [
        ("DGS10:2024-01-01", 4.1, "10yr_treasury_yield")]


@pytest.mark.parametrize("weeks, expected", [
    ([1, 2, 3], (0, 0, 0)), ([1, 2, 3, 4, 5], (15, 14, 5)), ([1] * 14, (13, 4, 13)),
    ([0] * 10 + [2] * 4, (8, 8, 4)), (None, (0, 0, 0))])
def test_repo_activity(spark, weeks, expected):
    df = feed(spark, schemas.REPO_FEED, {
        "asset_id": "btc", "owner": "o", "repo": "r", "stargazers_count": 3,
        "created_at": "2024-01-01T12:00:00Z", "weeks": weeks and [{"total": n} for n in weeks]})
    got = dicts(validate.repo_activity(df, moment(NOW)))[0]
    assert (got["commits_90d"], got["commits_30d"], got["contributors_count"]) == expected
    assert got["repo_age_days"] == 29 and got["repo_full_name"] == "o/r"


def test_repo_map_drops_incomplete_entries(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps([{"asset_id": "a", "owner": "o", "repo": "r"},
                                {"asset_id": "", "owner": "o", "repo": "r"}, {"asset_id": "b"}]))
    assert readers.read_repo_map(spark, str(path)).count() == 1


def test_usage_validation(spark):
    good = {"event_time": NOW, "request_id": "1", "tenant_id": "t", "route_selected": "genie",
            "model_or_engine": "m", "latency_ms": "5", "response_status": "success"}
    result = validate.validate_usage(feed(
        spark, schemas.USAGE_FEED, good, {**good, "route_selected": "dashboard.market-overview"},
        {**good, "latency_ms": None}, {**good, "response_status": "odd"},
        {**good, "prompt_tokens": "many"}, {**good, "prompt_tokens": ""}))
    assert sorted(r["route_selected"] for r in dicts(result.good)) == ["dashboard_api", "genie", "genie"]
    assert sorted(r["reasons"][0] for r in dicts(result.quarantine)) == [
        "invalid:prompt_tokens", "missing:latency_ms", "unsupported:response_status"]


def test_run_and_alert_validation(spark):
    runs = validate.validate_runs(feed(spark, schemas.RUN_FEED, {"job_name": "j", "status": "SUCCESS"},
                                       {"job_name": "j", "status": "success"}, {"status": "FAILED"}))
    assert runs.good.count() == 1 and runs.quarantine.count() == 2
    alerts = validate.validate_alerts(feed(
        spark, schemas.ALERT_FEED, {"kind": "error_spike", "message": "m"},
        {"kind": "model_drift", "message": "m", "source": "s"}, {"kind": "other", "message": "m"}))
    assert [r["source"] for r in dicts(alerts.good)] == [fv.DEFAULT_ALERT_SOURCE, "s"]


def test_contract_sees_extra_fields_in_raw_json(spark):
    raw = ['{"job_name": "j", "status": "SUCCESS"}', '{"job_name": "j", "status": "ODD", "x": 1}',
           '{"status": "FAILED", "duration_ms": -1}']
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(
        "raw", F.from_json("raw", schemas.RUN_FEED).alias("r")).select("raw", "r.*")
    rows = dicts(validate.check_contract(df, validate.RUN_CONTRACT, "raw").checked)
    assert [r["reasons"] for r in rows] == [
        [], ["enum:status", "additional_fields"], ["required:job_name", "minimum:duration_ms"]]


def test_request_validation(spark):
    good = {"tenant_id": "t", "session_id": "s", "request_id": "r", "locale": "en",
            "channel": "api", "request_type_hint": "auto", "message_text": "hi"}
    result = validate.validate_requests(feed(
        spark, schemas.REQUEST_LOG, good, {**good, "selected_assets": ["btc", "B!"]},
        {**good, "tenant_id": "a b"}, {**good, "message_text": "x" * 2001},
        {**good, "selected_assets": ["a"] * 26}, {**good, "api_version": "v2"}, {**good, "user_id": "u"}))
    assert result.good.count() == 2
    assert sorted(r["reasons"][0] for r in dicts(result.quarantine)) == [
        "invalid:selected_assets", "invalid:tenant_id", "too_long:message_text",
        "too_many:selected_assets", "unsupported:api_version"]


def test_gates(frame):
    df = frame("asset_id string, status string", ("a", "SUCCESS"), (None, "completed"))
    with pytest.raises(ValueError, match="null asset_id"):
        validate.assert_quality(df)
    with pytest.raises(ValueError, match="expected >= 3"):
        validate.assert_quality(df, 3)
    with pytest.raises(ValueError):
        validate.filter_assets(df, ["a'; --"])
    assert validate.filter_assets(df, None).count() == 2
    healthy = lambda d: dicts(validate.runs_healthy(d))[0]["healthy"]
    assert healthy(df) and healthy(df.limit(0))
    assert not healthy(df.withColumn("status", F.lit("FAILED")))


def test_align_keeps_shared_columns_in_target_order(frame):
    df = frame("b string, a int, extra int", ("1.5", 2, 3))
    out = align.align_to_schema(df, schemas.schema(a="long", missing="string", b="money"))
    assert out.dtypes == [("a", "bigint"), ("b", "decimal(38,8)")]


# Merges and sinks -------------------------------------------------------------------------------------

def test_insert_only_merge_is_idempotent(frame):
    target = frame("k string, v int", ("a", 1))
    source = frame("k string, v int", ("a", 9), ("b", 2), ("b", 3))
    once = writers.merge_insert_only(target, source, ["k"])
    twice = writers.merge_insert_only(once, source, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_upsert_keeps_the_newest(frame):
    target = frame("k string, t int, v string", ("a", 1, "old"), ("b", 5, "keep"), ("c", 2, "old"))
    source = frame("k string, t int, v string", ("a", 2, "new"), ("b", 4, "late"), ("c", 2, "tie"),
                   ("d", 1, "in"))
    got = writers.merge_upsert_newest(target, source, ["k"], "t")
    assert sorted((r.k, r.v) for r in got.collect()) == [
        ("a", "new"), ("b", "keep"), ("c", "tie"), ("d", "in")]


def test_append_new_rows_and_replace_folder(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    batch_rows = frame("k string, ts timestamp", ("a", NOW), ("b", NOW))
    for _ in range(2):
        writers.append_new_rows(spark, path, batch_rows, ["k", "ts"], prune_by="ts")
    assert spark.read.parquet(path).count() == 2
    writers.replace_folder(spark.read.parquet(path).filter("k = 'a'"), path)
    assert spark.read.parquet(path).count() == 1


def test_partitioned_overwrite_leaves_other_days(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    writers.overwrite_partitioned(frame("d string, v int", ("1", 1), ("2", 2)), path, ["d"])
    writers.overwrite_partitioned(frame("d string, v int", ("2", 5)), path, ["d"])
    assert sorted((str(r.d), r.v) for r in spark.read.parquet(path).collect()) == [("1", 1), ("2", 5)]


def test_clustered_layout_has_disjoint_files(spark, tmp_path):
    path = str(tmp_path / "c")
    writers.write_clustered(spark.range(1000).withColumn("k", F.col("id") % 97), path, ["k"])
    ranges = (spark.read.parquet(path).groupBy(F.input_file_name().alias("f"))
              .agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect())
    assert all(x.b <= y.a for x, y in zip(ranges, ranges[1:]))


def test_catalog_tables(spark, frame):
    writers.ensure_table(spark, "scores_t", schemas.GOLD_SCORES, ["asset_id"])
    writers.ensure_table(spark, "scores_t", schemas.GOLD_SCORES)
    assert spark.table("scores_t").count() == 0
    df = frame("v int", (1,))
    writers.overwrite_table(df, "plain_t")
    writers.append_table(df, "plain_t")
    assert spark.table("plain_t").count() == 2
    spark.sql("CREATE OR REPLACE VIEW a_view AS SELECT 1 AS x")
    assert writers.drop_if_view(spark, "a_view") and not writers.drop_if_view(spark, "plain_t")
    assert not writers.drop_if_view(spark, "a_view")


def test_handoff_defaults(spark, frame, tmp_path):
    path = str(tmp_path / "handoff")
    writers.write_handoff(frame("kind string, source string", ("k", None), ("k", "x")), path, "me", NOW)
    rows = dicts(spark.read.json(path))
    assert sorted(r["source"] for r in rows) == ["me", "x"]
    assert all(r["created_at"].startswith("2024-01-31") for r in rows)


def test_feed_to_silver_and_back(spark, tmp_path):
    feed_path = tmp_path / "feed.json"
    feed_path.write_text(json.dumps([ETH, {**ETH, "id": "btc", "symbol": "btc"}, {**ETH, "symbol": ""}]))
    paths = [str(tmp_path / name) for name in ("bronze", "bad", "silver")]
    for _ in range(2):
        batch.land_market(spark, str(feed_path), paths[0], paths[1], NOW)
    assert spark.read.parquet(paths[0]).count() == 2
    for _ in range(2):
        written = batch.refresh_silver(spark, paths[0], paths[2])
    assert written == {"silver_market_changes": 2, "silver_market_dominance": 2,
                       "silver_cross_asset_comparison": 2}
    assert spark.read.parquet(f"{paths[2]}/silver_market_changes").count() == 2
