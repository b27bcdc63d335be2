"""Queries of codes and metrics against their SQL on texts with letters beyond ASCII and signed zeros."""

from __future__ import annotations

import duckdb
import pytest

from loamfield import queries
from test_queries import _rows

#: The queries whose findings are settled here.
ODD = ["cascade_membership", "codebook_frequencies", "coded_segments", "entry_in_theme", "entry_results", "exported_by_theme", "frequent_themes", "joined_theme_labels", "metric_tags", "nested_themes", "outside_framework", "representative_quotes_minmedmax", "reviewed_codebook", "reviewed_themes"]

TEXTS = [
    "éthe Édie lesÈ words here",
    "dieà lesé theñ, all joined",
    "the, die; les. plain words 12",
    "RIGHTſ and licenſe with long letters",
    "rıghts and lİcense with other dots",
    "éthe a combining accent",
    "thé combining after it",
    "_the die_ les2 no bounds",
    "日本the本 and die日本 and les",
    "éthe wthe then, none of them",
    "short",
    "",
    None,
] * 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    out = str(tmp_path_factory.mktemp("odd"))
    # The codes' letters at bounds in long texts too, as quotes have over fifty characters.
    docs = [(i, t if t is None or i < len(TEXTS) // 2 else f"{t} {'- ' * 30}", "en", "src0", 100 * i) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    customers = [(1, -0.0), (2, 0.0), (3, -7.0), (4, 1234567.5), (1_000_000, -0.001)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").write.parquet(f"{out}/customer.parquet")
    return out


@pytest.mark.parametrize("name", ODD)
def test_odd_letters_and_zeros(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
