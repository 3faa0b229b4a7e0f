"""The driver's contract: names, the smoke query, and the SQL that must give the same rows."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import queries as core

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1] / "postmill"

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not there")


def test_the_core_never_imports_the_llm_subpackage():
    for path in ROOT.rglob("*.py"):
        if (ROOT / "llm") in path.parents:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("postmill.llm") for n in names), path


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_smoke(spark):
    found = entry.entry(spark)
    assert found.columns == ["brief_id", "position", "idx", "engagement", "score", "match_tier", "match_label"] and found.count() > 0


def _plain(value):
    return None if value is None or value != value else f"{value:.6f}" if isinstance(value, float) else str(value)


@needs_data
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_against_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"create view {file[:-8]} as select * from '{DATA}/{file}'")
    frame = core.queries()[name](spark, DATA)
    expected = connection.execute(core.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted((tuple(_plain(r[c]) for c in order) for r in frame.collect()), key=str)
    theirs = sorted((tuple(_plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in expected.fetchall()), key=str)
    assert mine == theirs
