"""The operators' queries and the pipeline over the small documents table."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from loamfield.llm import queries

TABLES = ("documents", "conversations", "pages", "labels")


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op5_quality", "op7_media", "op9_sentencepiece"])
def test_every_document_has_a_row(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name == "op9_sentencepiece":
        assert rows.where("NOT round_trip").count() == 0


def test_stages_on_awkward_and_empty_rows(spark, sf_dir, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, none, sf_dir).count() == 0, name
            out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert out.columns == docs.columns and set(columns) <= set(out.columns)
                assert out.count() <= docs.count()
                docs = out


def test_stages_in_order(spark, sf_dir):
    """Each stage against a plain version of what it should keep."""
    from test_near_and_exact import brute_components, brute_passages

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "exact_dedup":
            keep = {}
            for d, t in before.items():
                keep[t] = max(keep.get(t, d), d)
            assert set(after) == set(keep.values())
        elif name == "near_dedup":
            assert set(after) == {d for d, c in brute_components(list(before.items())).items() if c == d}
        elif name == "substring_dedup":
            want = {d: (before[d] if not gone else kept) for d, n, gone, kept in brute_passages(list(before.items())) if kept or not gone}
            assert after == want
        docs = out
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
