"""Registered queries against their SQL on the smallest tables, and the parts coming apart cleanly."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
SOME = ["f1_normalize_address", "f33_transfer_calldata", "p3_active_histories", "j1_trie_union", "j2_trie_legacy", "j9_confirmed_rule", "w3_prune", "a6_method_metrics", "a7_daily_metrics", "a9_tau_sweep", "a2_build_counterparties", "w6_top_counterparties", "f45_interactions", "w8_reverse_cumulative", "a17_block_summary", "st4_stream_static_detect", "src1_label_dump", "f37_event_day"]


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if not isinstance(v, (int, bool)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_equal_to_sql(spark, duck, name):
    from doppel.plans import registry

    df = registry.QUERIES[name](spark, DATA)
    cur = duck.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([plain(v) for v in r]) for r in cur.fetchall())
    assert got == want


def test_every_sql_has_its_query():
    from doppel.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 180


def test_works_without_the_training_data_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j1_trie_union' in q and 'pipeline' not in q and 'op1_quality' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
