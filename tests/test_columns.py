import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text as T
from tidemark.operators import requests
from tests.conftest import dicts


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_pct_change_null_and_zero_base(frame):
    df = frame("cur double, base double", (110.0, 100.0), (1.0, 0.0), (1.0, None), (50.0, 100.0))
    assert values(df, C.pct_change("cur", "base")) == [10.0, None, None, -50.0]


def test_cap_bucket_edges(frame):
    df = frame("r long", (10,), (11,), (50,), (51,), (None,))
    assert values(df, C.cap_bucket("r")) == [
        "large_cap", "mid_cap", "mid_cap", "broad_market", "broad_market"]


def test_regime_label_edges(frame):
    df = frame("p double", *[(x,) for x in (5.0, 5.1, -5.0, -5.1, 2.0, -2.0, 2.1)])
    assert values(df, C.regime_label("p")) == [
        "bear", "bull", "bear", "risk_off", "neutral", "neutral", "bear"]


def test_momentum_and_ratio(frame):
    df = frame("a double, b double", (10.0, 5.0), (None, 5.0))
    assert values(df, C.momentum("a", "b")) == [7.0, None]
    df = frame("v double, c double", (500.0, 1000.0), (1.0, 0.0), (1.0, None))
    assert values(df, C.vol_to_cap("v", "c")) == [0.5, None, None]


def test_dev_activity_score_truncates_and_caps(frame):
    df = frame("c long, s long, n long", (6, 500, 1), (90, 0, 0), (None, None, None))
    assert values(df, C.dev_activity_score("c", "s", "n")) == [17, 100, 0]


def test_quality_is_review_when_unknown(frame):
    df = frame("a double", (1.0,), (-1.0,), (None,))
    assert values(df, C.pass_or_review(F.col("a") >= 0)) == ["pass", "review", "review"]


def test_escalation_and_severity(frame):
    df = frame("k string", ("error_spike",), ("freshness_gap",), ("bundle_failure",), ("else",))
    assert values(df, C.escalation("k")) == ["page_oncall", "block_release", "page_oncall", "review"]
    assert values(df, C.severity("k")) == ["medium", "low", "high", "low"]


def test_run_state_unknown_is_failed(frame):
    df = frame("s string", ("succeeded",), ("Pending",), ("canceled",), ("odd",), (None,))
    assert values(df, C.run_state("s")) == ["success", "running", "cancelled", "failed", "failed"]


@pytest.mark.parametrize("raw, clean", [
    ("  hi \x00there\x0b ", "hi there"), ("a\tb\nc", "a\tb\nc"), (None, ""), ("x" * 2100, "x" * 2000)])
def test_sanitize(frame, raw, clean):
    assert values(frame("t string", (raw,)), T.sanitize("t")) == [clean]


def test_word_count_splits_like_text_split(frame):
    texts = ["", "  ", "one", "a b c", "x\x1cy", " lead and trail "]
    df = frame("t string", *[(t,) for t in texts])
    assert values(df, T.word_count("t")) == [len(t.split()) for t in texts]


def test_route_classes(frame):
    df = frame("message_text string", ("Compare BTC vs ETH",), ("Explain the trend",), ("hello",))
    rows = dicts(requests.classify_route(df))
    assert [r["route"] for r in rows] == ["genie", "copilot", "copilot"]
    assert rows[0]["route_signals"] == ["compare", "vs"]
    assert rows[1]["route_signals"] == ["explain", "trend"]
    assert rows[2]["route_reason"] == "default_copilot_path"


def test_tier_classes(frame):
    df = frame("message_text string, a int, t int",
               ("What is the price of BTC?", 1, 0), ("deep dive please", 0, 0),
               ("word " * 60, 0, 0), ("hi", 4, 0), ("hi", 0, 5), ("current price", 2, 0))
    rows = dicts(requests.classify_tier(df, "message_text", "a", "t"))
    assert [r["tier"] for r in rows] == [
        "light", "complex", "complex", "complex", "complex", "standard"]
    assert [r["tier_reason"] for r in rows][1:5] == [
        "complex_signal", "long_query", "high_asset_count", "deep_conversation"]
    assert [r["estimated_prompt_tokens"] for r in rows] == [30, 200, 200, 200, 200, 80]


def test_token_cost(frame):
    df = frame("t string, n int", ("light", 1000), ("complex", 500), ("other", 1000))
    assert values(df, T.token_cost("t", "n")) == [0.0008, 0.0125, 0.004]


def test_macro_labels(frame):
    df = frame("s string, v double, c double", ("DGS10", 4.1, None), ("DGS10", 1.9, None),
               ("DTWEXBGS", None, 2.1), ("M2SL", 1.0, -1.1), ("CPIAUCSL", 1.0, 0.4),
               ("DGS10", 3.0, None), ("OTHER", 9.0, 9.0))
    assert values(df, C.macro_regime_label("s", "v", "c")) == [
        "high_rates", "low_rates", "usd_strengthening", "liquidity_contracting",
        "inflation_rising", "neutral", "neutral"]
