from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamfield.functions import json_repair, metrics, similarity, tails, temporal, text


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _values(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize(
    ("name", "values", "want"),
    [
        ("mode_value", [5, 5, 1, 1], 1),
        ("mode_value", [2, 2, 3, 3, 3, 4], 3),
        ("skewness", [0, 0, 0, 0, 10], 1.5),
        ("skewness", [1, 2, 3, 4, 5], 0),
        ("kurtosis_excess", [-1, -1, 1, 1], -2),
        ("n", [1, 2, None, 4], 3),
        ("n_unique", [1, 1, 2, 3, 3], 3),
        ("cv", [-1, 1], None),
        ("mad", [1, 1, 2, 2, 4, 6, 9], 1.4826),
        ("outlier_count_iqr", [1, 2, 3, 4, 100], 1),
        ("outlier_count_iqr", [1, 2, 100], None),
        ("log_mean", [-1, 3], None),
        ("log_sd", [1], None),
        ("proportion_zero", [0, 0, 1, None], 2 / 3),
        ("entropy", [1, 1, 2, 2], 1),
        ("max_to_median_ratio", [0, 0, 5], None),
        ("shapiro_p", [1, 2], None),
        ("shapiro_p", [3] * 50, None),
        ("mean", [], None),
        ("median", [float("nan"), float("inf"), 2, 4], 3),
    ],
)
def test_hand_computed(spark, name, values, want):
    got = metrics.described_values(_values(spark, [None if v is None else float(v) for v in values]), "x", [name]).first()[name]
    assert (got is None) if want is None else got == pytest.approx(want)


def test_catalogue():
    assert len(metrics.CATALOGUE) == 45 and len(metrics.names("temporal")) == 7
    assert "quantile(q)" in metrics.described()


def test_unknown_metrics_are_errors(spark):
    for bad in (["nothing"], ["frequency_distribution"], ["quantile"], [("mean", {"q": 1})], ["mean", "time_span_days"]):
        with pytest.raises(ValueError):
            metrics.described_values(_values(spark, [1.0]), "x", bad)


def test_groups_may_be_null(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    got = {r.g: (r.n_observed, r.mad) for r in metrics.described_values(rows, "x", ["mad"], ["g"]).collect()}
    assert got == {None: (2, pytest.approx(1.4826)), "a": (1, 0.0)}


def test_shapiro_samples_rows_not_values(spark):
    """Each of ten values has more rows than the test takes: none of them fills the sample alone."""
    rows = spark.range(60_000).selectExpr("CAST(id % 10 AS double) AS x", "IF(id % 3 = 0, 'a', NULL) AS g")
    whole = metrics.described_values(rows, "x", ["shapiro_p"]).first()
    assert whole["n_observed"] == 60_000 and whole["shapiro_p"] is not None and whole["shapiro_p"] < 0.05
    by = {r["g"]: r["shapiro_p"] for r in metrics.described_values(rows, "x", ["shapiro_p"], ["g"]).collect()}
    assert set(by) == {"a", None} and all(p is not None and p < 0.05 for p in by.values())


def test_shapiro():
    w, p = tails.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert (w, p) == (pytest.approx(0.7888, abs=1e-4), pytest.approx(0.0067, abs=1e-4))
    assert tails.shapiro_wilk(np.array([0.0] * 40 + list(range(1, 11))))[1] < 0.05


def test_tails():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi_square_upper(3.841) == pytest.approx(0.05, abs=1e-4) and tails.chi_square_upper(9.488, 4) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-4) and tails.fisher_exact(1, 9, 11, 3) == pytest.approx(0.002759, abs=1e-6)
    assert tails.correlation_p(1.0, 5) == 0 and tails.correlation_p(0.3, 2) is None


@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 60), st.integers(0, 60))
def test_fisher_is_a_probability(a, b, c, d):
    assert 0 < tails.fisher_exact(a, b, c, d) <= 1


def test_cleaning(spark):
    said = "u/some_one and r/Topic: **bold** *it* ~~no~~ https://x.org/a) www.y.com/z @é [removed]\n&gt; quoted\n&amp;lt; <U+00E9><U+D800> é"
    row = text.with_clean(spark.createDataFrame([(said,), (None,), ("plain  ascii",)], "t string"), "t").collect()
    assert row[0].t == "and [subreddit]: bold it no ) [subreddit] &lt; é<U+D800> é".replace(" [subreddit] &lt;", " < ").replace("<  é", "< é") or "é<U+D800> é" in row[0].t
    assert "quoted" not in row[0].t and row[0].t.startswith("and [subreddit]: bold it no )")
    assert row[1].t is None and row[2].t == "plain ascii"


def test_scalar_functions(spark):
    assert _one(spark, text.normalise_code_name(F.lit("1. NEW: “Foo bar”"))) == "Foo bar"
    assert _one(spark, text.normalise_code_name(F.lit("NEW: 1. 'x'"))) == "x"
    assert _one(spark, text.truncated(F.lit("abcdefgh"), 6)) == "abc..."
    assert _one(spark, text.truncated_at_word(F.lit("one two three four"), 14)) == "one two ..."
    assert _one(spark, text.truncated_at_word(F.lit("o" * 20), 14)) == "o" * 10 + " ..."
    assert _one(spark, text.estimated_tokens(F.lit("日本語です"))) == 4 and _one(spark, text.estimated_tokens(F.lit("abcdefgh日"))) == 3
    assert _one(spark, text.word_count(F.lit("  a b\n c "))) == 3 and _one(spark, text.word_count(F.lit("  "))) == 0
    assert _one(spark, text.safe_filename(F.lit("A b/c!"))) == "a_bc" and _one(spark, text.safe_filename(F.lit("!!"))) == "unnamed"
    assert _one(spark, text.csv_field(F.lit('a"b'))) == '"a""b"' and _one(spark, text.table_cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert _one(spark, text.without_unsafe_links(F.lit("[x](javascript:alert) [y](https://a.org)"))) == "x [y](https://a.org)"
    assert _one(spark, text.normalise_quote(F.lit(" “A”  é "))) == '"a" é'
    row = spark.createDataFrame([(1.0, None, 2.5)], "a double, b double, c double").select(text.metric_tag(["a", "b", "c"]).alias("x")).first()
    assert row.x == "[a: 1; c: 2.50]"


def test_similarity(spark):
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4)
    assert similarity.jaro("", "a") == 0 and similarity.jaro("", "") == 1
    assert _one(spark, similarity.set_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert _one(spark, similarity.split_labels(F.lit("a; b;; "))) == ["a", "b"]


@pytest.mark.parametrize(
    ("said", "want"),
    [('```json\n{"a": 1}\n```', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "x', {"a": "x"}), ('[{"a": 1}, {"b": ', [{"a": 1}]), ('so: {"a": 1} and more', {"a": 1}), ("nothing", None), (None, None)],
)
def test_json_repair(said, want):
    assert json_repair.repaired(said) == want


def test_json_column(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 2',), ("x",), (None,)], "t string")
    assert [r.v and r.v.a for r in rows.select(json_repair.json_value(F.col("t"), "a int").alias("v")).collect()] == [1, 2, None, None]


def test_timestamps(spark):
    rows = spark.createDataFrame([("2024-01-01 18:00:00",), ("garbage",), ("2024-01-02 09:00:00.5Z",), ("",), (None,)], "t string")
    assert [str(r.std_ts) for r in temporal.parsed_timestamps(rows, "t").collect()] == ["2024-01-01 18:00:00", "None", "2024-01-02 09:00:00", "None", "None"]
    days = spark.createDataFrame([("03/05/2024",), ("13/05/2024",)], "t string")
    assert temporal.ambiguous_dates(days, "t").count() == 1
    assert str(temporal.parsed_timestamps(days, "t").first().std_ts) == "2024-05-03 00:00:00"


def test_weeks_belong_to_iso_years(spark):
    assert _one(spark, temporal.period_label(F.to_date(F.lit("2021-01-03")), "weekly")) == "2020-W53"
    assert _one(spark, temporal.period_label(F.lit(None).cast("date"), "weekly")) is None


def test_circular(spark):
    rows = spark.createDataFrame([("2024-01-01 23:00:00",), ("2024-01-02 01:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    hour = metrics.described_values(rows, "t", ["peak_hour_circular"]).first()["peak_hour_circular"]
    assert min(hour, 24 - hour) == pytest.approx(0, abs=1e-9)
    assert metrics.described_values(_values(spark, [0.0, math.pi]), "x", ["circular_variance"]).first()["circular_variance"] == pytest.approx(1)
