"""Registered queries against their SQL on the smallest tables, and the entry module without the optional operators."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["pit_latest_version", "universe_asof", "total_return", "censor_windows", "rolling_single", "sector_corr", "run_books", "reprice_suite", "news_events", "group_weight", "isin_check", "listing_diff", "name_match", "fdr_edges_of_closes", "land_prices", "isin_lookup", "sector_backfill", "lei_match", "lead_lag_pairs", "harvested_relations", "returns_recomputed", "schema_steps", "member_snapshots", "onboarding_runs", "feed_account", "isin_import", "isin_import_refused", "custody_sets", "board_interlocks", "board_seats", "graph_load", "land_series", "exposure_tensor"]


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = entry_module.queries()[name](spark, small)
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in df.columns) for r in df.collect()), key=repr) == want


def test_every_customer_name_is_looked_up(spark, small):
    from tidemark.queries.names import _names
    from tidemark.views import Tables

    names = {r["name"] for r in _names(Tables(spark, small)).collect()}
    asked = {r["name"] for r in entry_module.queries()["name_match"](spark, small).collect()}
    assert all(n in asked or n.removesuffix("A.Ş.") in asked for n in names)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_the_optional_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "tidemark", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tidemark").mkdir()
    for p in (ROOT / "tidemark").iterdir():
        if p.name != "llm":
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_only_ingestion_may_reach_the_network_and_reads_go_through_views():
    for p in (ROOT / "tidemark").rglob("*.py"):
        tree = ast.parse(p.read_text())
        names = {n.name.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.Import) for n in x.names} | {(x.module or "").split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.ImportFrom)}
        assert not names & {"requests", "urllib", "httpx", "socket", "http"}, p
        if "llm" not in p.parts:
            assert not any(isinstance(x, ast.ImportFrom) and "llm" in (x.module or "") for x in ast.walk(tree)), p
