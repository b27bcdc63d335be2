"""Queries that take whole tables and whole texts, against brute force on small tables."""

from __future__ import annotations

import datetime as dt

from loamfield import queries


def _docs(spark, tmp_path) -> tuple[str, dict[int, list[str]]]:
    late = "filler " * 60
    texts = {1: f"One two {late}Three", 2: f"two four {late}five  six", 3: None, 4: "", 60: f"one {late}{late}seven two", 61: "seven eight"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {d: [w for w in (t or "").lower().split(" ") if w] for d, t in texts.items()}


def test_months_of_all_orders(spark, tmp_path):
    days = [(1, "A", dt.datetime(2024, 1, 5)), (2, "A", dt.datetime(2024, 1, 31)), (57, "A", dt.datetime(2024, 4, 1)), (3, "B", dt.datetime(2023, 12, 1))]
    spark.createDataFrame(days, "o_custkey long, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.queries()["entries_by_month_dense"](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderpriority, r.label, r.n) for r in got) == [("A", "2024-01", 2), ("A", "2024-02", 0), ("A", "2024-03", 0), ("A", "2024-04", 1), ("B", "2023-12", 1)]


def test_labels_of_whole_texts(spark, tmp_path):
    sf, words = _docs(spark, tmp_path)
    got = {r.label: (r.n, r.pct) for r in queries.queries()["multilabel_emotions"](spark, sf).collect()}
    n = {w: sum(w in v for v in words.values()) for v in words.values() for w in v}
    assert got == {w: (k, round(100 * k / len(words), 6)) for w, k in n.items()}


def test_saturation_of_all_words(spark, tmp_path):
    sf, words = _docs(spark, tmp_path)
    got = [tuple(r) for r in queries.queries()["saturation_curve"](spark, sf).orderBy("n_coded").select("n_coded", "n_codes", "n_recent", "slope").collect()]
    seen, born, assigned, want = set(), {}, 0, []
    for d in sorted(words):
        born[d] = len(set(words[d]) - seen)
        seen |= set(words[d])
        assigned += len(set(words[d]))
        want.append((d, len(seen), sum(k for b, k in born.items() if b > d - 50), round(len(seen) / assigned, 9)))
    assert got == want
