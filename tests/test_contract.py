"""A cross-section of the registered queries against their SQL; check.py runs them all."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

SAMPLE = [
    "s1_prepared_events", "s4_lake_range", "f2_common_filters", "f6_event_times", "f7_enrichment", "e3_merged_sessions",
    "e5_session_audit", "e9_sessionize", "a4_session_stats", "a9_activity_histograms", "a22_kpi_digest",
    "j1_ordered_funnel", "j8_conversion_paths", "j12_transition_links", "c2_cart_sessions", "c3_order_pairs",
    "c11_abandonment_by_channel", "r4_monthly_retention_orders", "r5_monthly_cohorts_orders", "t5_landing_pages",
    "p4_cross_sell", "p5_personalized", "p7_session_candidates", "m1_interactions", "m14_session_features",
    "m19_product_rules", "w7_exactly_once",
]


@pytest.fixture(scope="module")
def con(tables):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, tables, name):
    text, _, good = compare(spark, con, name, tables)
    assert good, text


def test_entry_and_keys(spark):
    assert contract.entry(spark).count() == 6
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("gone", [["corpus_pipeline.py"], []])
def test_entry_without_the_text_folders(tmp_path, gone):
    """Without the text operators (and their pipeline) all other queries are registered."""
    home = Path(contract.__file__).parent
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *gone)
    shutil.copytree(home, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    rest = {n for n in contract.queries() if n != "pipeline" and not n.startswith("op")}
    assert set(found.stdout.split()) == rest and len(rest) > 180
