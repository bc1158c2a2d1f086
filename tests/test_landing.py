"""Feeds from files to tables and quarantine."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.validate import REASONS
from tidemark.plans import batch, landing
from tests.conftest import dicts

NOW = "2024-01-31 00:00:00"
USAGE = {"event_time": "2024-01-30T10:00:00Z", "request_id": "r1", "tenant_id": "t", "route_selected": "genie",
         "model_or_engine": "m", "latency_ms": 5, "response_status": "success"}
MARKET = {"id": "eth", "symbol": "eth", "name": "E", "last_updated": "2024-01-30T10:00:00Z", "market_cap": 5,
          "current_price": 2, "total_volume": 3, "circulating_supply": 4, "market_cap_rank": 1}

# feed: good records, bad ones with their reasons
RECORDS = {
    "market": ([MARKET], [({**MARKET, "symbol": ""}, ["missing:symbol"])]),
    "protocols": ([{"name": "A B", "tvl": "5", "mcap": 2}, {"slug": "x", "tvl": 1, "chains": ["eth"]}],
                  [({"tvl": 5}, ["missing:protocol_slug"]), ({"slug": "y", "tvl": "n/a"}, ["missing:tvl_usd"]),
                   ({"slug": "z", "tvl": "1e40"}, ["invalid:tvl_usd"])]),
    "repos": ([{"asset_id": "a", "owner": "o", "repo": "r", "weeks": [{"total": 1}] * 5}],
              [({"asset_id": "b", "owner": "", "repo": "r"}, ["missing:owner"])]),
    "usage": ([USAGE, {**USAGE, "request_id": "r2", "route_selected": "dashboard.market-overview"}],
              [({**USAGE, "latency_ms": "slow"}, ["invalid:latency_ms"]),
               ({**USAGE, "event_time": "yesterday"}, ["invalid:event_time"]),
               ({**USAGE, "route_selected": "elsewhere", "tenant_id": None},
                ["missing:tenant_id", "unsupported:route_selected"])]),
    "runs": ([{"job_name": "j", "status": "SUCCESS"}, {"job_name": "j", "status": "SUCCESS"}],
             [({"job_name": "j", "status": "BROKEN"}, ["unsupported:status"]),
              ({"job_name": "j", "status": "SUCCESS", "update_time": "soon"}, ["invalid:update_time"])]),
    "alerts": ([{"kind": "error_spike", "message": "m"}], [({"kind": "other", "message": "m"}, ["unsupported:kind"])]),
}


def _write(path, records, *broken):
    path.write_text("\n".join([*map(json.dumps, records), *broken]))
    return str(path)


def _quarantine(spark, path):
    rows = landing.landed_rows(spark, path, landing.QUARANTINE)
    return sorted((r["feed"], sorted(r[REASONS]), r["record"]) for r in dicts(rows))


@pytest.mark.parametrize("name", sorted(RECORDS))
def test_every_record_lands_once(spark, tmp_path, name):
    good, bad = RECORDS[name]
    path = _write(tmp_path / "feed.json", [*good, *(record for record, _ in bad)], "{broken", "17")
    paths = [str(tmp_path / "table"), str(tmp_path / "bad")]
    for _ in range(2):  # a rerun adds nothing
        found = landing.land(spark, name, path, *paths, NOW, "day-1")
        assert found == landing.Landed(len(good), len(bad) + 2)
    feed = landing.FEEDS[name]
    rows = landing.landed_rows(spark, paths[0], feed.table)
    assert rows.count() == len(good) and [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in feed.table]
    assert rows.filter(F.col(feed.required).isNull()).count() == 0
    kept = _quarantine(spark, paths[1])
    assert sorted(reasons for _, reasons, _ in kept) == sorted([*(sorted(r) for _, r in bad), ["unreadable"], ["unreadable"]])
    assert {"{broken", "17"} <= {record for _, _, record in kept} and {f for f, _, _ in kept} == {name}
    # another landing comes beside it
    landing.land(spark, name, path, *paths, "2024-02-01 00:00:00", "day-2")
    assert len(_quarantine(spark, paths[1])) == 2 * len(kept)
    assert landing.landed_rows(spark, paths[0], feed.table).count() == len(good) * (1 if feed.merged else 2)


def test_macro_observations_land_one_by_one(spark, tmp_path):
    path = _write(tmp_path / "feed.json", [
        {"series_id": "DGS10", "observations": [{"date": "2024-01-01", "value": "4.5"}, {"date": "2024-01-02", "value": "."},
                                                {"date": "", "value": "1"}, {"date": "2024-01-01", "value": "4.5"}]},
        {"series_id": "OTHER", "observations": [{"date": "2024-01-01", "value": "1"}]},
        {"series_id": "M2SL", "observations": []}, {"series_id": "M2SL"}])
    paths = [str(tmp_path / "table"), str(tmp_path / "bad")]
    for _ in range(2):
        assert landing.land(spark, "macro", path, *paths, NOW) == landing.Landed(1, 3)
    row, = dicts(landing.landed_rows(spark, paths[0], landing.FEEDS["macro"].table))
    assert row["source_record_id"] == "DGS10:2024-01-01" and float(row["value"]) == 4.5
    assert [(reasons, json.loads(record)) for _, reasons, record in _quarantine(spark, paths[1])] == [
        (["missing:observation_date"], {"series_id": "DGS10", "date": "", "value": "1"}),
        (["missing:value"], {"series_id": "DGS10", "date": "2024-01-02", "value": "."}),
        (["unsupported:series_id"], {"series_id": "OTHER", "date": "2024-01-01", "value": "1"})]


def test_gate(spark, tmp_path):
    paths = [str(tmp_path / "table"), str(tmp_path / "bad")]
    empty = _write(tmp_path / "empty.json", [])
    with pytest.raises(ValueError, match="0 rows, expected >= 1"):
        batch.land_market(spark, empty, *paths, NOW)
    full = _write(tmp_path / "full.json", [MARKET])
    assert batch.land_market(spark, full, *paths, NOW) == landing.Landed(1, 0)
    # the table has rows, so an empty file passes; a feed that lands in folders is judged by its landing
    assert batch.land_market(spark, empty, *paths, NOW) == landing.Landed(0, 0)
    with pytest.raises(ValueError, match="expected >= 1"):
        landing.land(spark, "usage", None, f"{paths[0]}-usage", paths[1], NOW, min_rows=1)
    with pytest.raises(ValueError, match="name"):
        landing.land(spark, "usage", None, f"{paths[0]}-usage", paths[1], NOW, "a/b")


def test_whole_file_json(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps([USAGE, {**USAGE, "tenant_id": ""}], indent=1))
    paths = [str(tmp_path / "table"), str(tmp_path / "bad")]
    assert landing.land(spark, "usage", str(tmp_path / "feed.json"), *paths, NOW, lines=False) == landing.Landed(1, 1)
