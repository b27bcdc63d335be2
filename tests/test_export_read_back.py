"""Entries by theme, written and read back, against SQL: odd characters in texts, and no entry in any theme."""

from __future__ import annotations

import duckdb
import pytest

from loamfield import queries
from test_queries import _rows

TEXTS = {
    "odd": ['"the end" and \0', 'the \0"\0 die', "the\n\0les", "\0,the die\0", '\x01"the"\x01 les', '"the\\" die\\', "\r\nthe\r die\n", "the 12 \U00010000￿", '""the"" \\"die\\"'],
    "none": ["nothing of note in here", "short", "", None],
    "empty": [],
}


@pytest.mark.parametrize("kind", TEXTS)
def test_exported_by_theme(spark, tmp_path, kind):
    spark.createDataFrame([(i, t, "en", "src0", i) for i, t in enumerate(TEXTS[kind])], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["exported_by_theme"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["exported_by_theme"])
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
