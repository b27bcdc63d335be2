"""Every query of the engine against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import sys

import duckdb
import pytest

import __spark_entry__
from loamfield import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(x) -> str:
    if isinstance(x, float):
        return f"{x:.6g}" if x == x else "nan"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(_text, x)) + "]"
    return str(float(x)) if type(x).__name__ == "Decimal" else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_has_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    import ast
    from pathlib import Path

    root = Path(queries.__file__).parent
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path
    assert "pandas" in sys.modules
