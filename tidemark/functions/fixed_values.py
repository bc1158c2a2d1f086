"""Names, limits and word lists that decide results, stated as they are."""

# Market feed
SOURCE_SYSTEMS = ["coingecko_api", "internal_reference", "partner_feed"]
DEFAULT_SOURCE_SYSTEM = "coingecko_api"
DEFAULT_PAYLOAD_VERSION = "coingecko_markets_v1"
PROTOCOL_SOURCE, PROTOCOL_VERSION = "defillama", "defillama_protocols_v1"
MACRO_SOURCE, MACRO_VERSION = "fred", "fred_observations_v1"
REPO_SOURCE, REPO_VERSION = "github", "github_activity_v1"
MACRO_SERIES = {
    "DGS10": "10yr_treasury_yield",
    "M2SL": "m2_money_supply",
    "CPIAUCSL": "cpi_inflation",
    "DTWEXBGS": "usd_trade_index",
}
STABLECOINS = ["USDT", "USDC", "DAI", "FDUSD", "TUSD"]

# Lookback windows in minutes before the row: (nearest, farthest), both inclusive
CHANGE_WINDOWS = {"1h": (55, 65), "24h": (1380, 1500), "7d": (9960, 10200)}
COMPARISON_WINDOWS = {"24h": (1410, 1470), "7d": (9960, 10200)}

# Usage log
ROUTES = ["genie", "copilot", "dashboard_api", "internal_app"]
RESPONSE_STATUSES = ["success", "partial", "refused", "error"]
STALE_WATERMARKS = ["", "unknown", "pending"]
# route, max latency in ms, max cost in USD, max tokens
ROUTE_POLICY = [
    ("genie", 500, 0.02, 1200),
    ("copilot", 1200, 0.05, 4000),
    ("dashboard_api", 250, 0.005, 800),
    ("internal_app", 800, 0.03, 2500),
]
ROUTE_ALIASES = {"dashboard.market-overview": "dashboard_api"}
DASHBOARD_ROUTE, DASHBOARD_ENGINE = "dashboard.market-overview", "dashboard-api"
DEFAULT_ENGINE, DEFAULT_TIER = "mosaic-ai-agent-framework", "standard"

# Job runs
RUN_STATUSES = ["SUCCESS", "FAILED", "CANCELLED", "RUNNING", "QUEUED", "PENDING"]
RUN_SUCCESS = ["SUCCESS", "SUCCEEDED", "COMPLETED"]
RUN_ACTIVE = ["RUNNING", "QUEUED", "PENDING"]
RUN_CANCELLED = ["CANCELLED", "CANCELED"]

# Alerts
RUN_ALERTS = ["bundle_failure", "bundle_cancelled"]
RUNTIME_ALERTS = ["latency_breach", "cost_anomaly", "freshness_gap", "token_spike", "error_spike"]
MODEL_ALERTS = ["model_drift", "retrain_trigger"]
HIGH_SEVERITY_KINDS = ["bundle_failure", "bundle_cancelled", "error_spike"]
MEDIUM_SEVERITY_KINDS = [
    "error_spike", "latency_breach", "cost_anomaly", "model_drift", "retrain_trigger",
]
DEFAULT_ALERT_SOURCE = "sentinela"
ESCALATIONS = {
    "error_spike": "page_oncall",
    "latency_breach": "investigate_performance",
    "cost_anomaly": "review_budget",
    "freshness_gap": "block_release",
    "token_spike": "review_model_usage",
    "missing_telemetry": "block_release",
    "bundle_failure": "page_oncall",
    "bundle_cancelled": "page_oncall",
}
ALERT_MESSAGES = {
    "error_spike": "Response errors detected for this route.",
    "latency_breach": "Latency exceeded the operational threshold.",
    "cost_anomaly": "Estimated cost exceeded the target threshold.",
    "freshness_gap": "Freshness metadata is missing or stale.",
    "token_spike": "Token usage is above the expected copilot bound.",
}
RUN_EVENT_MESSAGE = "Databricks bundle job %s %s."
BLOCKER_MESSAGES = {
    "latency_breach": "Route latency exceeded readiness threshold.",
    "cost_anomaly": "Route cost exceeded readiness threshold.",
    "token_spike": "Route token usage exceeded readiness threshold.",
    "freshness_gap": "Freshness metadata is missing or stale.",
    "error_spike": "Route returned an error status.",
}

# Request log
CHANNELS = ["web_dashboard", "web_chat", "api"]
REQUEST_HINTS = ["analytics_nlq", "copilot", "dashboard_query", "auto"]
API_VERSIONS = ["v1"]
OVERVIEW_PHRASES = ["market overview", "visao geral do mercado"]
RUNTIME_ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
ASSET_ID_PATTERN = r"^[a-z0-9][a-z0-9\-_]{0,63}$"
STRUCTURED_SIGNALS = [
    "rank", "ranking", "top", "compare", "comparison", "versus", "vs", "dominan", "market cap",
    "highest", "lowest", "volume", "price change", "table", "across", "by asset",
]
NARRATIVE_SIGNALS = [
    "explain", "summarize", "summary", "what is happening", "context", "insight", "trend", "story",
]
LIGHT_SIGNALS = [
    "what is the price", "current price", "price of", "how much is", "what's the price",
    "whats the price", "preço do", "cotação do", "market cap of", "is it up", "is it down",
    "subiu", "caiu",
]
COMPLEX_SIGNALS = [
    "analyze the relationship", "portfolio analysis", "correlation between",
    "historical analysis", "macro regime", "risk assessment", "multi-asset", "across all assets",
    "comprehensive analysis", "deep dive", "defi and macro", "tvl and price", "compare macro",
    "explain why the market", "why is bitcoin", "why did the market", "analise de portfolio",
    "analise completa", "relacao entre",
]
COST_PER_1K_TOKENS = {"light": 0.0008, "standard": 0.0040, "complex": 0.0250}

# Access
ADMIN_GROUPS = ["platform_ops", "governance_admin"]

# Fixed values of the drift log and the alert log.
DRIFT_SOURCE = "model_drift_monitoring_job"
EVALUATION_SOURCE = "sentinela_evaluation_job"
DRIFT_MESSAGE = ("Regime PSI=%.3f exceeds threshold %s (24h distribution vs 7d-1d baseline, "
                 "non-overlapping windows). dist_24h=%s, dist_baseline=%s")
RETRAIN_MESSAGE = ("Sustained regime drift detected: %d PSI breaches in last %d days. "
                   "Manual or automated retraining recommended.")
