import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from tidemark.operators import requests
from tests.conftest import dicts

START = datetime(2024, 1, 1)


def brute_force(events, limit, seconds):
    """One key after the other, event by event."""
    held, out = {}, {}
    for key, ts, i in sorted(events, key=lambda e: (e[1], e[2])):
        bucket = held.setdefault(key, deque())
        while bucket and bucket[0] <= ts - timedelta(seconds=seconds):
            bucket.popleft()
        if len(bucket) < limit:
            bucket.append(ts)
            out[i] = (True, 0)
        else:
            out[i] = (False, max(1, int(seconds - (ts - bucket[0]).total_seconds())))
    return out


def traffic(rng, shape):
    """Hot key in bursts and lulls, cold keys, ties."""
    clock, events = 0.0, []
    for i in range(600):
        step = {"burst": rng.choice([0, 0, 0.2, 1, 70]), "steady": rng.choice([1, 2, 3]),
                "light": rng.choice([5, 20, 90])}[shape]
        clock += step
        events.append((rng.choice("hhhhab"), START + timedelta(seconds=round(clock, 3)), i))
    return events


@pytest.mark.parametrize("shape", ["burst", "steady", "light"])
def test_admission_equals_brute_force(spark, shape):
    events = traffic(random.Random(shape), shape)
    df = spark.createDataFrame(events, "k string, ts timestamp, i int")
    got = {r["i"]: (r["admitted"], r["retry_after_s"]) for r in dicts(
        requests.rate_limit(df, ["k"], "ts", ["i"], limit=12, seconds=60))}
    want = brute_force(events, 12, 60)
    assert got == want
    assert shape == "light" or not all(ok for ok, _ in want.values())


def test_admission_over_many_small_batches(spark):
    events = traffic(random.Random(5), "steady")
    df = spark.createDataFrame(events, "k string, ts timestamp, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["i"]: (r["admitted"], r["retry_after_s"]) for r in dicts(
            requests.rate_limit(df, ["k"], "ts", ["i"], limit=4, seconds=30))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_force(events, 4, 30)


def test_missing_user_counts_as_anonymous(frame):
    df = frame("t string, u string, ts timestamp", *[("t", None, "2024-01-01 00:00:00")] * 2,
               ("t", "", "2024-01-01 00:00:01"))
    rows = dicts(requests.rate_limit(df, ["t", "u"], "ts", ["u"], limit=2, seconds=60))
    assert len(rows) == 3 and sorted(r["admitted"] for r in rows) == [False, True, True]


def test_dispatch(frame):
    df = frame("request_id string, channel string, request_type_hint string, message_text string",
               ("1", "api", "dashboard_query", "x"), ("2", "api", "analytics_nlq", "x"),
               ("3", "api", "copilot", "top assets"), ("4", "web_dashboard", "auto", " Market Overview "),
               ("5", "api", "auto", "market overview"), ("6", "api", "auto", "top assets"))
    rows = {r["request_id"]: (r["surface"], r["rate_limited_surface"]) for r in dicts(requests.dispatch(df))}
    assert rows == {"1": ("dashboard", False), "2": ("genie", True), "3": ("copilot", True),
                    "4": ("dashboard", False), "5": ("copilot", True), "6": ("genie", True)}


def test_sources_are_distinct_in_first_seen_order(spark):
    df = spark.createDataFrame([("r", 2, ["b", "c"], 5), ("r", 1, ["a", "b"], 7), ("e", 1, [], 3),
                                ("n", 1, None, None)],
                               "request_id string, part int, sources array<string>, token_count int")
    rows = {r["request_id"]: (r["sources"], r["total_tokens"]) for r in dicts(requests.merge_sources(df))}
    assert rows == {"r": (["a", "b", "c"], 12), "e": ([], 3), "n": ([], 0)}


def test_stretches_are_told_apart_at_every_cut_of_the_batches():
    """Many short stretches, cut into batches of each size: what is held ends with its stretch, not with its batch."""
    import numpy as np
    import pyarrow as pa
    from tidemark.functions.admission import admit
    rng, rows = random.Random(2), []
    for key, stretch in (("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3), ("c", 9)):
        clock = 0
        for _ in range(rng.randint(1, 9)):
            clock += rng.choice([0, 400_000, 2_000_000, 31_000_000])
            rows.append((key, stretch, clock))
    want = []
    for name in dict.fromkeys(r[:2] for r in rows):
        ok, retry, _ = admit(np.array([r[2] for r in rows if r[:2] == name]), [], 2, 30_000_000)
        want += list(zip(ok.tolist(), retry.tolist()))
    for size in range(1, len(rows) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + size])], ["_k0", "_stretch", "_t"])
                   for i in range(0, len(rows), size)]
        got = [r for b in requests._stretch_decider(["_k0"], 2, 30_000_000)(iter(batches)) for r in b.to_pylist()]
        assert [(r["admitted"], r["retry_after_s"]) for r in got] == want
