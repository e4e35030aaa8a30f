"""Whole runs: from stored tables to landed results and a report. The driver sees verdicts and figures of a few rows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import books, events, factors, judge, monitors, network, pit, returns, risk
from ..sources import landing, reference
from ..sources.store import Store, write_report
from ..tables import cut

#: The families of variants that are searched.
STATARB_GRID = {"accum": [1, 5, 10], "z_threshold": [0.0, 1.0], "least_corr": [0.0, 0.2]}
EVENT_GRID = {"quantile": [0.2, 0.3], "drift": [3, 5, 10], "lag": [1, 2]}


def build_returns(store: Store, *, as_of: str, fx: str = "USDTRY", cpi: str = "CPI", yields: DataFrame | None = None, symbols: DataFrame | None = None, overwrite: bool = True) -> DataFrame:
    """Total returns of all symbols at once (or of some) from what was known, landed in the store.

    Returns are derived: each is known on its bar's day, and computing it again is no new
    version. With ``overwrite`` the recomputed span of each symbol gives way in one step,
    so a corrected bar, or a rate that came late, changes the stored return; without it
    only days that are not there yet are added.
    """
    reader = pit.PitReader(as_of, store.read)
    prices = reader.table("prices")
    prices = prices if symbols is None else prices.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    bars = pit.latest_version(prices, "symbol", "bar_date")
    levels = pit.latest_version(reader.table("factors"), "factor", "bar_date")
    out = returns.total_returns(bars.drop("is_limit_lock"), levels.where(F.col("factor") == fx), levels.where(F.col("factor") == cpi), yields)
    rows = out.withColumn("knowledge_date", F.col("bar_date"))
    if overwrite:
        store.overwrite_recomputed("total_returns", rows)
    else:
        store.append("total_returns", rows)
    return store.read("total_returns")


def factor_panel(store: Store, *, as_of: str, methods: dict[str, str] | None = None, require_all: bool = False) -> tuple[DataFrame, list[str]]:
    """(panel, order): returns of the factors that are there, weekly ones aligned by the day they were known."""
    methods = methods or factors.specs()
    levels = pit.latest_version(pit.PitReader(as_of, store.read).table("factors"), "factor", "bar_date")
    present = [r[0] for r in levels.select("factor").distinct().where(F.col("factor").isin(*methods)).collect()]  # at most the manifest's
    if require_all and set(methods) - set(present):
        raise ValueError(f"factors without levels: {sorted(set(methods) - set(present))}")
    all_ = factors.factor_returns(levels, methods)
    weekly = [f for f in factors.weekly_factors() if f in present]
    daily = all_.where(~F.col("factor").isin(*weekly)) if weekly else all_
    grid = daily.select("bar_date").distinct()
    for f in weekly:
        aligned = factors.align_by_knowledge(all_.where(F.col("factor") == f), grid)
        daily = daily.unionByName(aligned.select(F.lit(f).alias("factor"), "bar_date", F.col("bar_date").alias("knowledge_date"), "ret"))
    order = factors.order_present(sorted(present))
    return factors.factor_panel(daily, order), order


def refit(store: Store, *, as_of: str, methods: dict[str, str] | None = None, window: int = 60, least: int = 40, report_dir: str | None = None) -> dict:
    """Betas and residuals of all symbols in one grouped job each, in place of the earlier fit; that stays until both are computed."""
    panel, order = factor_panel(store, as_of=as_of, methods=methods)
    rets = pit.latest_version(pit.PitReader(as_of, store.read).table("total_returns"), "symbol", "bar_date").select("symbol", "bar_date", F.col("ret_usd").alias("ret"))
    known = F.lit(as_of).cast("date")
    betas = factors.rolling_betas(rets, panel, order, window=window, least=least)
    residuals = factors.rolling_residuals(rets, panel, order, window=window, least=least)
    betas, residuals = cut(betas, "betas"), cut(residuals, "residuals")
    store.replace("betas", betas.select("symbol", "factor", "bar_date", "beta", F.lit("ledoit_wolf").alias("method"), F.lit(window).alias("window"), "regime", known.alias("knowledge_date")))
    store.replace("residuals", residuals.select("symbol", "bar_date", "residual", "strip_order", known.alias("knowledge_date")))
    n = {t: store.read(t).count() for t in ("betas", "residuals")}
    out = {"as_of": as_of, "factors": order, "n_betas": n["betas"], "n_residuals": n["residuals"]}
    if report_dir:
        write_report(report_dir, "factor_model", out)
    return out


def gate_diagnostics(store: Store, *, as_of: str, before: str, after: str, least: int = 20, window: int = 60, window_least: int = 40, report_dir: str | None = None) -> dict:
    """What the landed fit explains by class, and the break between two regimes: of its betas, and of betas fitted anew on the primary factors near the break."""
    reader = pit.PitReader(as_of, store.read)
    rets = pit.latest_version(reader.table("total_returns"), "symbol", "bar_date").select("symbol", "bar_date", F.col("ret_usd").alias("ret"))
    residuals = pit.latest_version(reader.table("residuals"), "symbol", "bar_date")
    classes = pit.universe_classes(store.read("universe_membership"), as_of)
    shares = factors.variance_share(rets, residuals, least, classes)
    whole = factors.break_by_factor(factors.regime_break(pit.latest_version(reader.table("betas"), "symbol", "factor", "bar_date"), before, after))
    levels = pit.latest_version(reader.table("factors"), "factor", "bar_date")
    primary = factors.regime_break_on(rets, factors.factor_returns(levels, {f: m for f, m in factors.specs().items() if f in factors.PRIMARY}), before, after, window=window, least=window_least, nearest=window_least)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row for each class or factor
    out = {"as_of": as_of, "variance_share_by_class": rows(factors.share_by_class(shares)), "n_names_scored": shares.count(), "regime_break": rows(whole), "regime_break_primary": rows(primary), "regimes": [before, after]}
    if report_dir:
        write_report(report_dir, "gate_diagnostics", out)
    return out


def robustness_grid(residuals: DataFrame, leaves: DataFrame, sectors: DataFrame, *, windows: tuple[int, ...] = (90, 120, 150), step: int = 60, least: int = 60, report_dir: str | None = None) -> list[dict]:
    """The survival gate by leaf and by main sectors and over several windows; ``leaves`` has (symbol, sector), ``sectors`` (code, level, parent)."""
    cells = []
    for name, dealt in (("leaf", leaves), ("main", reference.rolled_up(leaves, sectors))):
        n = dealt.select("sector").distinct().count()
        for window in windows:
            r = survival_gate(residuals, dealt, window=window, step=step, least=least).first().asDict()
            cells.append({"granularity": name, "n_sectors": n, "window": window, **r})
    if report_dir:
        write_report(report_dir, "robustness", {"cells": cells})
    return cells


def survival_gate(residuals: DataFrame, sectors: DataFrame, *, window: int = 120, step: int = 60, alpha: float = 0.05, least: int = 60) -> DataFrame:
    """The gate's figures and decision over rolling windows of significant edges within sectors."""
    p = network.panel(residuals, "residual", least)
    c = network.correlations(network.windows(p, window, step), sectors, least, ("w",))
    edges = network.fdr_edges(c, alpha, by=("w",)).select("w", "src", "dst", "corr")
    return network.gate(network.stability_summary(network.stability(edges, c.groupBy("w").agg(F.count("*").alias("n_candidates")))))


def statarb_panels(store: Store, *, as_of: str, least: int = 60) -> DataFrame:
    """The residual panel with returns, locks and short eligibility, as known on a day: see ``books.signal_panels``."""
    reader = pit.PitReader(as_of, store.read)
    newest = lambda table: pit.latest_version(reader.table(table), "symbol", "bar_date")
    rets = newest("total_returns").select("symbol", "bar_date", F.col("ret_usd").alias("ret"), "limit_lock_adj")
    return books.signal_panels(network.panel(newest("residuals"), "residual", least), rets, newest("short_eligible"))


def statarb(residuals: DataFrame, rets: DataFrame, sectors: DataFrame, *, accums: tuple[int, ...] = tuple(STATARB_GRID["accum"]), thresholds: tuple[float, ...] = tuple(STATARB_GRID["z_threshold"]), least_corrs: tuple[float, ...] = tuple(STATARB_GRID["least_corr"]), lookback: int = 60, window: int = 250, step: int = 60, n_splits: int = 5, purge: int = 5, embargo: int = 5, least: int = 60) -> dict:
    """Spread signals of a grid of variants, picked walk-forward, and judged against luck.

    Edges come from the first ``least`` days' correlations onwards by the rolling
    schedule: each refit sees only the days before it is used.
    """
    p = network.panel(residuals, "residual", least).withColumnRenamed("x", "ret")
    sched = books.schedule(p, window, step).select("refit", "first", "last", "effective", F.coalesce("until", F.lit("9999-12-31").cast("date")).alias("until"))
    spans = p.join(F.broadcast(sched), F.col("bar_date").between(F.col("first"), F.col("last")))  # refits are few
    c = network.correlations(spans.select("symbol", "bar_date", F.col("ret").alias("x"), "refit"), sectors, least, ("refit",))
    c = c.persist()
    wide = books.dense(p, "ret")
    active = wide.join(F.broadcast(sched.select("refit", "effective", "until")), (F.col("bar_date") >= F.col("effective")) & (F.col("bar_date") < F.col("until")))
    peers = active.select("refit", "bar_date", F.col("symbol").alias("peer"), F.col("ret").alias("v"))
    forward = rets.select("symbol", "bar_date", F.col("ret").alias("fwd"))
    # one frame for all variants: the least correlation is a key of the spreads, the others are choices of the scores
    edges = network.fdr_edges(c, by=("refit",))
    both = edges.select("refit", F.col("src").alias("symbol"), F.col("dst").alias("peer"), "corr").unionByName(edges.select("refit", F.col("dst").alias("symbol"), F.col("src").alias("peer"), "corr"))
    floors = F.explode(F.array(*map(F.lit, least_corrs)))
    used = both.withColumn("least_corr", floors).where(F.abs("corr") >= F.col("least_corr"))
    predicted = used.join(peers, ["refit", "peer"]).groupBy("least_corr", "symbol", "bar_date").agg(F.try_divide(F.sum(F.col("corr") * F.coalesce("v", F.lit(0.0))), F.sum(F.abs("corr"))).alias("predicted"))
    spread = wide.withColumn("least_corr", floors).join(predicted, ["least_corr", "symbol", "bar_date"], "left").withColumn("spread", F.col("ret") - F.col("predicted"))
    scored = books.fade_scores(spread, [(f"a{n}|z{z}", n, z) for n in accums for z in thresholds], lookback=lookback, keys=("least_corr", "symbol"))
    named = scored.withColumn("variant", F.concat("variant", F.lit("|c"), F.col("least_corr").cast("string")))
    weights = books.dollar_neutral(named, "score", by=("variant", "bar_date")).join(forward, ["symbol", "bar_date"], "left")
    out = _verdict(_net_of_variants(weights), rets, n_splits, purge, embargo)
    c.unpersist()
    return out


def _net(weights: DataFrame) -> DataFrame:
    """Daily results in the venue-feasible book."""
    research = books.books(weights.sparkSession).where("book = 'venue_feasible'")
    return books.daily_pnl(books.constrain(weights.join(F.broadcast(research))))  # one row


def _net_of_variants(weights: DataFrame) -> DataFrame:
    """(variant, bar_date, net): each variant is a book of its own by the rules of the venue-feasible one."""
    rules = books.books(weights.sparkSession).where("book = 'venue_feasible'").drop("book")
    ruled = weights.withColumnRenamed("variant", "book").join(F.broadcast(rules))  # one row
    return books.daily_pnl(books.constrain(ruled)).select(F.col("book").alias("variant"), "bar_date", "net")


def _verdict(pnl: DataFrame, rets: DataFrame, n_splits: int, purge: int, embargo: int) -> dict:
    """The variants picked walk-forward, against luck, overfitting and the baselines."""
    pnl = pnl.persist()
    days = pnl.select("bar_date").distinct().count()
    splits = books.walk_forward(days, n_splits, purge, embargo)
    oos = books.spliced(pnl, books.pick_variants(pnl, splits), splits)
    m = judge.moments(oos.withColumn("all", F.lit(1)), "all").first()
    trial = [r["sharpe"] for r in judge.moments(pnl, "variant").collect()]  # one a variant
    blocks = judge.safe_blocks(days)
    pbo = judge.overfitting_summary(judge.overfitting(pnl, blocks)).first() if blocks else None
    dsr = judge.deflated_sharpe(m["sharpe"], m["n"], m["skew"], m["kurtosis"], len(trial), trial_sharpes=trial) if m and m["sharpe"] is not None else None
    wide, base = books.dense(rets, "ret"), {}
    for name, scored in {"momentum": books.momentum(wide), "differential_exposure": books.trailing_beta(wide), "own_event": books.own_event(wide)}.items():
        w = books.dollar_neutral(scored, "score").withColumn("fwd", F.col("ret"))
        base[name] = books.performance(_net(w), "book").first()["net_sharpe"]
    pnl.unpersist()
    return judge.verdict(m["sharpe"] if m else None, base, dsr, pbo and pbo["pbo"]) | {"n_trials": len(trial), "n_days": m["n"] if m else 0}


def event_signal(betas: DataFrame, rets: DataFrame, specs: DataFrame, *, quantiles: tuple[float, ...] = tuple(EVENT_GRID["quantile"]), drifts: tuple[int, ...] = tuple(EVENT_GRID["drift"]), lags: tuple[int, ...] = tuple(EVENT_GRID["lag"]), n_splits: int = 5, purge: int = 5, embargo: int = 5) -> dict:
    """Differential exposure around events in a grid of variants, picked walk-forward and judged; ``betas`` by channel. Days without an event are held flat."""
    forward = books.dense(rets, "ret").withColumnRenamed("ret", "fwd")
    choices = [(f"q{q}|d{d}|l{lag}", q, d, lag) for q in quantiles for d in drifts for lag in lags]
    names = F.explode(F.array(*(F.lit(name) for name, *_ in choices)))
    weights = forward.withColumn("variant", names).join(events.drift_grid(betas, specs, choices), ["variant", "symbol", "bar_date"], "left")
    return _verdict(_net_of_variants(weights), rets, n_splits, purge, embargo)


def scenario_analysis(store: Store, *, as_of: str, weights: DataFrame | None = None, report_dir: str | None = None) -> dict:
    """All stylised scenarios on the newest exposures; those that touch no exposed channel are listed."""
    exposed = risk.exposures(pit.latest_version(pit.PitReader(as_of, store.read).table("betas"), "symbol", "factor", "bar_date"))
    shocks = risk.scenarios(store.spark)
    priced = risk.reprice(exposed, shocks)
    out = {"as_of": as_of, "scenarios": [r.asDict() for r in risk.stress_summary(priced, "scenario").collect()], "skipped": [r[0] for r in risk.unshockable(exposed, shocks).collect()]}
    if weights is not None:
        out["portfolio"] = {r["scenario"]: r["pnl"] for r in priced.join(weights, "symbol").groupBy("scenario").agg(F.sum(F.col("weight") * F.col("pnl")).alias("pnl")).collect()}
    if report_dir:
        write_report(report_dir, "scenarios", out)
    return out


def linkage_shock(edges: DataFrame, controls: DataFrame, shocks: DataFrame, *, max_hops: int = 6, least_confidence: float = 0.0, worst: int = 10) -> dict:
    """Shocks carried to holders, the cycles met, shocked nodes nobody holds, and who they control."""
    carried, cycles = risk.propagate(edges, shocks, max_hops, least_confidence)
    unheld = shocks.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    radius = risk.reach(controls, shocks, 12, "both")
    return {"worst": [r.asDict() for r in carried.orderBy("shock", "holder").limit(worst).collect()], "cycles": cycles.count(), "unmapped": [r["node"] for r in unheld.select("node").collect()], "n_reached": radius.select("node").distinct().count()}


def keep_current(companies: DataFrame, upstream: DataFrame, store: Store, symbols: DataFrame, *, as_of: str, report_dir: str | None = None) -> dict:
    """One cycle's heartbeat: new listings, identifiers, registry and freshness."""
    health = monitors.bridge_health(companies).first().asDict()
    diff = {r["change"]: r["count"] for r in monitors.listing_diff(upstream, companies).groupBy("change").count().collect()}
    bad = judge.registry_hygiene(store.read("signal_registry")).count()
    fresh = {r["status"]: r["count"] for r in monitors.freshness(symbols, monitors.latest_bars(pit.visible(store.read("total_returns"), as_of)), as_of).groupBy("status").count().collect()}
    reasons = [n for n, ok in {"identifiers": health["healthy"], "registry": bad == 0, "listings": not diff, "freshness": set(fresh) <= {"current"}}.items() if not ok]
    out = {"as_of": as_of, "green": not reasons, "reasons": reasons, "health": health, "listings": diff, "registry_problems": bad, "freshness": fresh}
    if report_dir:
        write_report(report_dir, "keep_current", out)
    return out


def event_inputs(store: Store, *, as_of: str, panel_start: str | None = None, channel_factor: dict[str, str] = risk.CHANNEL_FACTOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(specs, betas by channel, returns) as known on a day; returns and betas from ``panel_start`` on, as years before the first event only dilute a signal that fires on events."""
    reader = pit.PitReader(as_of, store.read)
    specs = events.event_specs(reader.table("events"), reader.table("event_targets"))
    floor = F.col("bar_date") >= F.lit(panel_start or "0001-01-01").cast("date")
    rets = pit.latest_version(reader.table("total_returns"), "symbol", "bar_date").where(floor).select("symbol", "bar_date", F.col("ret_usd").alias("ret"))
    channel = F.create_map(*(F.lit(x) for c, f in channel_factor.items() for x in (f, c)))[F.col("factor")]
    betas = pit.latest_version(reader.table("betas"), "symbol", "factor", "bar_date").where(floor & F.col("factor").isin(*channel_factor.values()))
    return specs, betas.select("symbol", channel.alias("channel"), "bar_date", "beta"), rets


def daily_update(store: Store, symbols: DataFrame, *, as_of: str, fetch: Callable[[DataFrame], DataFrame] | None = None, max_age: int = 7, overlap: int = 5, limit: int | None = None, report_dir: str | None = None) -> dict:
    """Brings the stale symbols up to date, each from a little before its last bar; without ``fetch`` it only says what it would do.

    ``fetch`` takes (symbol, start, end) and gives (symbol, payload), such as a feed
    source reads them. Symbols that gave nothing are reported, the others are landed.
    """
    fresh = monitors.freshness(symbols, monitors.latest_bars(pit.visible(store.read("prices"), as_of)), as_of, max_age)
    plan = cut(monitors.daily_plan(fresh, as_of, overlap=overlap, limit=limit), "plan")
    out = {"as_of": as_of, "mode": "execute" if fetch else "dry-run", "freshness": {r["status"]: r["count"] for r in fresh.groupBy("status").count().collect()}, "n_to_pull": plan.select("symbol").distinct().count()}
    if fetch:
        got = cut(fetch(plan), "feed")
        rows = landing.price_rows(got)
        out["landed"] = landing.land(store, "prices", rows)
        out["n_failed"] = plan.select("symbol").distinct().join(rows.select("symbol").distinct(), "symbol", "left_anti").count()
    if report_dir:
        write_report(report_dir, "daily_update", out)
    return out


def onboard(store: Store, market: DataFrame, payloads: DataFrame, sectors: DataFrame, *, as_of: str, valid_from: str) -> DataFrame:
    """(symbol, status): new symbols' bars, returns and universe class are landed; one the vendor has not yet waits, one without a sector has prices only and no class is guessed.

    ``market`` is what ``monitors.market_data`` says of them. Betas wait for the next
    refit, for which a new symbol has too few days.
    """
    carried = market.where("market_data != 'not_carried_yet'").select("symbol")
    bars = cut(landing.price_rows(payloads).join(carried, "symbol", "left_semi"), "bars")
    landing.land(store, "prices", bars)
    build_returns(store, as_of=as_of, symbols=bars)
    classes = cut(landing.class_rows(bars.select("symbol"), sectors), "classes")
    known = classes.where("status = 'derived'")
    landing.land(store, "universe_membership", known.select("symbol", F.lit("listed").alias("universe"), "universe_class", F.lit(valid_from).cast("date").alias("valid_from"), F.lit("sector").alias("source"), F.lit(as_of).cast("date").alias("knowledge_date")), day="valid_from")
    status = F.when(F.col("market_data") == "not_carried_yet", "deferred_vendor_lag").when(F.col("status").isNull(), "no_bars").when(F.col("status") == "derived", "quant_started").otherwise("prices_only_no_sector")
    return market.join(classes.select("symbol", "status"), "symbol", "left").select("symbol", status.alias("status"))
