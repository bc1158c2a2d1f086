import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import ops
from tidemark.streaming.admission import stream_rate_limit
from tidemark.streaming.health import stream_route_health
from tidemark.streaming.ingest import market_stream, stream_ingest
from tests.conftest import dicts
from tests.test_requests import brute_force

START = datetime(2024, 1, 1)


def test_ingest_inserts_each_key_once(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def land(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(
            {"id": asset, "symbol": "s", "market_cap": 1, "current_price": 2, "total_volume": 3,
             "circulating_supply": 4, "market_cap_rank": 5, "last_updated": seen}) for asset, seen in rows))
        (stream_ingest(market_stream(spark, str(folder)), out, mark)
         .trigger(availableNow=True).start().awaitTermination())

    land("1.json", ("btc", "2024-01-01T00:00:00Z"), ("btc", "2024-01-01T00:00:00Z"), ("", "2024-01-01T00:00:00Z"))
    land("2.json", ("btc", "2024-01-01T00:00:00Z"), ("eth", "2024-01-01T01:00:00Z"))
    rows = spark.read.parquet(out)
    assert sorted((r.asset_id, r.source_record_id) for r in rows.collect()) == [
        ("btc", "btc:2024-01-01T00:00:00Z"), ("eth", "eth:2024-01-01T01:00:00Z")]
    # a lost checkpoint replays everything; the merge against the target stops it
    (stream_ingest(market_stream(spark, str(folder)), out, mark + "2")
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 2


def test_late_rows_are_inserted_and_rejects_kept(spark, tmp_path):
    """Three micro-batches, the last of them far behind: nothing is lost, repeats add nothing."""
    folder, out, bad = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad")
    folder.mkdir()
    for name, asset, day in (("1", "btc", 20), ("2", "eth", 21), ("3", "ada", 1), ("4", "ada", 1), ("5", "", 2)):
        (folder / f"{name}.json").write_text(json.dumps(
            {"id": asset, "symbol": "s", "market_cap": 1, "current_price": 2, "total_volume": 3, "circulating_supply": 4,
             "market_cap_rank": 5, "last_updated": f"2024-01-{day:02}T00:00:00Z"}))
    (stream_ingest(market_stream(spark, str(folder), files_per_batch=1), out, str(tmp_path / "mark"), quarantine_path=bad)
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.asset_id for r in spark.read.parquet(out).collect()) == ["ada", "btc", "eth"]
    assert spark.read.parquet(bad).count() == 1


def test_late_and_untimed_requests_get_a_decision(spark, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    for hour in (10, 12, 1, None):
        seen = None if hour is None else START + timedelta(hours=hour)
        spark.createDataFrame([("k", seen, hour or 0)], "k string, ts timestamp, i int").coalesce(1).write.mode(
            "append").parquet(source)
    stream = (spark.readStream.schema("k string, ts timestamp, i int").option("maxFilesPerTrigger", 1).parquet(source))
    (stream_rate_limit(stream, ["k"], "ts", ["i"], limit=4, seconds=30).writeStream.outputMode("append").format("parquet")
     .option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination())
    assert {r["i"]: r["admitted"] for r in dicts(spark.read.parquet(out))} == {10: True, 12: True, 1: True, 0: None}


def test_stream_health_equals_batch_for_closed_hours(spark, tmp_path):
    schema = ("event_time timestamp, route_selected string, latency_ms int, total_tokens int,"
              "cost_estimate double, freshness_watermark string, response_status string")
    rng = random.Random(4)
    rows = [(START + timedelta(minutes=i), rng.choice(["genie", "copilot"]), rng.randint(1, 900), 5, 0.5,
             rng.choice([None, "x"]), rng.choice(["success", "error"])) for i in range(300)]
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode(
            "append").parquet(source)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    (stream_route_health(stream, "3 hours").writeStream.outputMode("append").format("parquet")
     .option("path", out).option("checkpointLocation", mark)
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out)
    batch = ops.route_health(ops.usage_normalized(spark.createDataFrame(rows, schema)))
    closed = batch.filter(F.col("hour_bucket") < got.agg(F.max("hour_bucket")).first()[0]
                          + F.expr("INTERVAL 1 HOUR"))
    key = lambda df: sorted(map(str, df.select(*batch.columns).collect()))
    assert got.count() > 0 and key(got) == key(closed)


def test_stream_admission_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    clock, events = 0.0, []
    for i in range(200):
        clock += rng.choice([0, 1, 2, 8])
        events.append((rng.choice("hhhb"), START + timedelta(seconds=clock), i))
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    for part in range(2):
        spark.createDataFrame(events[part * 100:(part + 1) * 100], "k string, ts timestamp, i int"
                              ).coalesce(1).write.mode("append").parquet(source)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 2
    stream = (spark.readStream.schema("k string, ts timestamp, i int")
              .option("maxFilesPerTrigger", 1).parquet(source))
    (stream_rate_limit(stream, ["k"], "ts", ["i"], limit=4, seconds=30).writeStream
     .outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark)
     .trigger(availableNow=True).start().awaitTermination())
    got = {r["i"]: (r["admitted"], r["retry_after_s"]) for r in dicts(spark.read.parquet(out))}
    assert got == brute_force(events, 4, 30)


def test_a_replayed_batch_replaces_its_rejects_and_broken_lines_keep_their_text(spark, tmp_path):
    from tidemark.streaming import ingest
    folder, out, bad, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "mark")
    folder.mkdir()
    good = {"id": "btc", "symbol": "s", "market_cap": 1, "current_price": 2, "total_volume": 3, "circulating_supply": 4,
            "market_cap_rank": 5, "last_updated": "2024-01-01T00:00:00Z"}
    broken = '{"id": "eth", "symbol": '
    (folder / "1.json").write_text("\n".join([json.dumps(good), broken, json.dumps(good | {"id": ""})]))
    (stream_ingest(market_stream(spark, str(folder)), out, mark, quarantine_path=bad)
     .trigger(availableNow=True).start().awaitTermination())
    found = {r.raw_line: r.validation_reasons if "validation_reasons" in r else r[ingest.REASONS] for r in spark.read.parquet(bad).collect()}
    assert found[broken] == [ingest.UNREADABLE] and len(found) == 2 and found[None] != [ingest.UNREADABLE]
    assert [r.asset_id for r in spark.read.parquet(out).collect()] == ["btc"] and "raw_line" not in spark.read.parquet(out).columns
    # The commit of the batch is lost, so the same batch runs again.
    (tmp_path / "mark" / "commits" / "0").unlink()
    (tmp_path / "mark" / "commits" / ".0.crc").unlink(missing_ok=True)
    (stream_ingest(market_stream(spark, str(folder)), out, mark, quarantine_path=bad)
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(bad).count() == 2 and spark.read.parquet(out).count() == 1


def test_many_keys_of_a_bucket_keep_times_of_their_own(spark, tmp_path, monkeypatch):
    """All keys in one bucket, null and empty ones and such whose parts run together; two micro-batches."""
    from tidemark.streaming import admission
    monkeypatch.setattr(admission, "BUCKETS", 1)
    keys = [("a", "bc"), ("ab", "c"), (None, "x"), ("", "x"), ("x", None), ("-", "x"), (None, None)]
    rng, clock, events = random.Random(4), 0, []
    for i in range(160):
        clock += rng.choice([0, 1, 3])
        events.append((rng.choice(keys), START + timedelta(seconds=clock), i))
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    for part in (events[:80], events[80:]):
        spark.createDataFrame([(*k, ts, i) for k, ts, i in part], "k string, l string, ts timestamp, i int").coalesce(1).write.mode(
            "append").parquet(source)
    stream = spark.readStream.schema("k string, l string, ts timestamp, i int").option("maxFilesPerTrigger", 1).parquet(source)
    (stream_rate_limit(stream, ["k", "l"], "ts", ["i"], limit=2, seconds=30).writeStream.outputMode("append").format("parquet")
     .option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination())
    got = {r["i"]: (r["admitted"], r["retry_after_s"]) for r in dicts(spark.read.parquet(out))}
    assert got == brute_force(events, 2, 30)


def test_a_missing_integer_key_leaves_other_keys_their_own_times(spark, tmp_path):
    """Integer keys and a missing one that share a partition."""
    events = [(k, START + timedelta(seconds=10 * n), 10 * n + (k or 0)) for n in range(6) for k in (None, 1, 2, 3)]
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    spark.createDataFrame(events, "k long, ts timestamp, i int").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k long, ts timestamp, i int").parquet(source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (stream_rate_limit(stream, ["k"], "ts", ["i"], limit=2, seconds=30).writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r["i"]: (r["admitted"], r["retry_after_s"]) for r in dicts(spark.read.parquet(out))}
    assert got == brute_force(events, 2, 30)
