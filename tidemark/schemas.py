"""Stored tables: columns and primary keys, and the steps by which columns came later. Reads and writes map columns by name."""

from __future__ import annotations

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "prices": ("symbol string, bar_date date, open double, high double, low double, close double, volume_try double, quantity double, adjusted boolean, is_limit_lock boolean, is_stale boolean, source string, knowledge_date date", ("symbol", "bar_date", "knowledge_date")),
    "total_returns": ("symbol string, bar_date date, ret_usd double, ret_real_try double, ret_nominal_try double, limit_lock_adj boolean, knowledge_date date", ("symbol", "bar_date", "knowledge_date")),
    "factors": ("factor string, bar_date date, value double, ret double, source string, knowledge_date date", ("factor", "bar_date", "knowledge_date")),
    "foreign_flow": ("symbol string, period string, grain string, net_flow_try double, source string, knowledge_date date", ("symbol", "period", "grain", "knowledge_date")),
    "betas": ("symbol string, factor string, bar_date date, beta double, method string, window int, regime string, universe_class string, knowledge_date date", ("symbol", "factor", "bar_date", "knowledge_date")),
    "residuals": ("symbol string, bar_date date, residual double, strip_order string, universe_class string, knowledge_date date", ("symbol", "bar_date", "knowledge_date")),
    "residual_corr": ("symbol_a string, symbol_b string, window_end date, window int, value double, p_value double, sign int, method string, fdr_passed boolean, knowledge_date date", ("symbol_a", "symbol_b", "window_end", "knowledge_date")),
    "accounting_regime": ("symbol string, period string, regime string, knowledge_date date", ("symbol", "period", "knowledge_date")),
    "universe_membership": ("symbol string, universe string, universe_class string, valid_from date, valid_to date, source string, knowledge_date date", ("symbol", "universe", "valid_from", "knowledge_date")),
    "short_eligible": ("symbol string, bar_date date, short_eligible boolean, source string, knowledge_date date", ("symbol", "bar_date", "knowledge_date")),
    "signal_registry": ("signal_id string, hypothesis string, feature_family string, train_start date, train_end date, test_start date, test_end date, n_trials int, cost_model string, purge_embargo string, deflated_sharpe double, pbo double, beat_baselines boolean, book string, promoted boolean, knowledge_date date", ("signal_id", "knowledge_date")),
    "events": ("event_id string, event_date date, date_precision string, event_type string, actors string, geography string, severity double, source string, knowledge_date date", ("event_id", "knowledge_date")),
    "listed_members": ("code string, ticker string, name string, member_type string, knowledge_date date", ("code", "knowledge_date")),
    "onboarding": ("symbol string, step string, attempt int, status string, detail string, knowledge_date date", ("symbol", "step", "attempt")),
    "event_targets": ("event_id string, channel string, shock_sign int, shock_magnitude double, confidence double, evidence_tier string, uncertainty double, source string, knowledge_date date", ("event_id", "channel", "knowledge_date")),
}

NODES: dict[str, str] = {
    "company": "uuid string, ticker string, name string, isin string, lei string, filing_id string, legal_form string, jurisdiction string, is_listed boolean",
    "person": "uuid string, name string",
    "security": "uuid string, issuer string, isin string, ticker string, type string, currency string",
    "sector": "code string, name string, parent string, level int",
    "portfolio": "uuid string, name string",
    "disclosure": "index long, title string, published date",
}
EDGES: dict[str, str] = {
    "holds_stake": "src string, dst string, pct double, as_of date, source string, confidence double",
    "controls": "src string, dst string, basis string, as_of date, source string, confidence double",
    "subsidiary_of": "src string, dst string, as_of date, source string",
    "board_member_of": "src string, dst string, role string, since date",
    "in_sector": "src string, dst string, sector_basis string",
    "subsector_of": "src string, dst string",
    "holds": "src string, dst string, weight double, qty double",
    "issues": "src string, dst string",
}

#: Keys of the graph's tables.
NODE_KEYS: dict[str, tuple[str, ...]] = {"company": ("uuid",), "person": ("uuid",), "security": ("uuid",), "sector": ("code",), "portfolio": ("uuid",), "disclosure": ("index",)}
EDGE_KEYS: dict[str, tuple[str, ...]] = {name: ("src", "dst") for name in EDGES}

#: All stored tables, as they were at version 1.
STORED: dict[str, tuple[str, tuple[str, ...]]] = TABLES | {t: (NODES[t], k) for t, k in NODE_KEYS.items()} | {t: (EDGES[t], k) for t, k in EDGE_KEYS.items()}

#: Columns added since, by version of the schema; they are only ever added.
SCHEMA_VERSION = 2
STEPS: tuple[tuple[int, str, str, str], ...] = (
    (2, "company", "listing_status", "string"),
    (2, "security", "issuer_name", "string"),
    (2, "security", "description", "string"),
    (2, "security", "maturity_date", "date"),
    (2, "security", "maturity_confidence", "double"),
    (2, "security", "nominal", "double"),
    (2, "security", "nominal_currency", "string"),
    (2, "security", "nominal_source", "string"),
    (2, "security", "nominal_as_of", "date"),
    (2, "security", "nominal_confidence", "double"),
    (2, "security", "nominal_basis", "string"),
    (2, "security", "is_amortizing", "boolean"),
    (2, "security", "issue_date", "date"),
    (2, "issues", "instrument_class", "string"),
    (2, "issues", "source", "string"),
    (2, "issues", "extraction_method", "string"),
    (2, "issues", "confidence", "double"),
    *((2, edge, "extraction_method", "string") for edge in ("holds_stake", "controls", "subsidiary_of", "board_member_of")),
    (2, "subsidiary_of", "confidence", "double"),
    (2, "board_member_of", "confidence", "double"),
    (2, "board_member_of", "source", "string"),
    (2, "in_sector", "source", "string"),
    (2, "in_sector", "as_of", "date"),
)
