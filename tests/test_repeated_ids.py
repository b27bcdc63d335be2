"""Queries of codes against their SQL where several entries have one id and some have none."""

from __future__ import annotations

import duckdb
import pytest

from loamfield import queries
from test_queries import _rows

#: The queries whose findings are settled here.
ODD = ["coded_segments", "entry_results", "representative_quotes_minmedmax"]

LONG = " - no more of note, but over fifty characters long"
ROWS = [
    (1, "the end of 12", 900),
    (1, "it is the end, and les", 1700),
    (1, None, 100),
    (2, "die rights, once" + LONG, 50),
    (2, "die rights, twice" + LONG, 50),
    (2, "die rights, another score" + LONG, 1990),
    (3, "les rights by themselves" + LONG, 1000),
    (4, "short", 1),
    (4, "short", 2),
    (None, "the license without an id" + LONG, 0),
    (None, "the license without an id" + LONG, 1),
    (None, "short", 3),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    out = str(tmp_path_factory.mktemp("repeated"))
    docs = [(i, t, "en", "src0", n) for i, t, n in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ODD)
def test_repeated_and_missing_ids(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
