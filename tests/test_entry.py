"""The driver's contract: names, SQL twins on the smallest tables, and life without the text-corpus operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quillgraph import queries as engine

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
SOME = ["q_scan_source_ids", "q_assign_reductions", "q_quantifiers", "q_insert_grouped", "q_relate_equi", "q_merge_reanchor", "q_split_two", "q_diff"]


def test_every_engine_query_has_sql():
    assert set(engine.ORACLE_SQL) == set(engine.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = engine.QUERIES[name](spark, DATA)
    cur = con.execute(engine.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, cur.fetchall()))


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_text_operators(tmp_path):
    """Without llm, its tests and the pipeline, the entry still imports and has the engine's queries."""
    for part in ("quillgraph", "__spark_entry__.py"):
        source = REPO / part
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_text_operators():
    for p in (REPO / "quillgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
