"""Ranks, quantiles and curves over ranges, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamfield.functions import ranges
from loamfield.operators import association, coding, themes


def test_quantiles_of_hot_null_and_small_groups(spark):
    rng = random.Random(4)
    rows = [("many", rng.choice([7.5, rng.gauss(0, 50)])) for _ in range(25_000)] + [("few", 3.0), ("few", -1.0), ("one", 2.0), ("none", None), (None, 4.0), (None, 8.0)]
    qs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r["_q"] for r in ranges.quantiles(df, "x", qs, ["g"]).collect()}
    assert got.keys() == {g for g, _ in rows} and got["none"] is None
    for g in got.keys() - {"none"}:
        assert got[g] == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], qs).tolist())
    assert ranges.quantiles(df, "x", [0.5]).first()["_q"] == pytest.approx([np.median([x for _, x in rows if x is not None])])
    assert ranges.quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGES", 8)
    rng = random.Random(5)
    values = {(g, float(x)): rng.randint(1, 9) for g in "ab" for x in rng.sample(range(1000), 300)}
    df = spark.createDataFrame([(g, x, k) for (g, x), k in values.items()], "g string, x double, k long").repartition(4)
    for r in ranges.with_before(df, "x", "k", "before", ["g"]).collect():
        assert r.before == sum(k for (g, x), k in values.items() if g == r.g and x < r.x)


def test_even_sample(spark):
    rows = [(i // 3 if i < 60 else i,) for i in range(500)]
    for n in (1, 2, 7, 499, 600):
        got = sorted(r.o for r in coding.even_sample(spark.createDataFrame(rows, "o long"), "o", n).collect())
        wanted = sorted({round(1 + i * 499 / (n - 1)) for i in range(n)}) if n > 1 else [1]
        assert got == (sorted(rows[w - 1][0] for w in wanted) if n < 500 else sorted(r[0] for r in rows))


def test_curve_over_runs(spark, monkeypatch):
    monkeypatch.setattr(coding, "RUN", 16)
    births = {i: (i * 7 % 5, 3) for i in range(0, 200, 3)}
    rows = spark.createDataFrame([(i, b, a) for i, (b, a) in births.items()], "n_coded long, n_births long, n_assigned long")
    for window in (10, 16, 50):
        for r in coding.saturation_curve(rows, window).collect():
            n = sum(b for i, (b, _) in births.items() if i <= r.n_coded)
            assert (r.n_codes, r.n_recent) == (n, sum(b for i, (b, _) in births.items() if r.n_coded - window < i <= r.n_coded))
            assert r.slope == pytest.approx(n / sum(a for i, (_, a) in births.items() if i <= r.n_coded))


def test_extreme_quotes_by_hand(spark):
    rng = random.Random(6)
    rows = [(t, f"{i:04d}", i, rng.choice([None, 0.0, 0.0, rng.random()]), "x" * 60) for t, n in (("a", 1), ("b", 2), ("c", 3), ("d", 200)) for i in range(n)] + [("d", "short", 9999, -5.0, "y")]
    df = spark.createDataFrame(rows, "theme string, std_id string, n long, score double, std_text string")
    for order in ("std_id", "n"):
        got = {(r.theme, r.position): r.std_id for r in themes.extreme_quotes(df, "score", order).collect()}
        want = {}
        for t in "abcd":
            of = sorted((r for r in rows if r[0] == t and len(r[4]) > 50), key=lambda r: (math.inf if r[3] is None else r[3], r[1]))
            want[t, "most_negative"] = of[0][1]
            if len(of) >= 3:
                want[t, "median"] = of[math.ceil(len(of) / 2) - 1][1]
            if len(of) >= 2:
                want[t, "most_positive"] = of[-1][1]
        assert got == want


def test_themes_against_the_rest(spark):
    """The same figures as with a row for each entry and theme."""
    rng = random.Random(7)
    entries = spark.createDataFrame([(i, rng.choice([1.0, 2.0, rng.random()]), None if i % 11 == 0 else rng.random()) for i in range(200)], "std_id long, x double, y double")
    member = spark.createDataFrame([(i, t) for i in range(200) for t in "ABC" if rng.random() < 0.3] + [(1, "rare")], "std_id long, theme string")
    pairs = entries.crossJoin(member.select("theme").distinct()).join(member.withColumn("m", F.lit(1)), ["std_id", "theme"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    columns = ["group", "variable", "n1", "n2", "u", "effect_r", "mean_1", "mean_2", "p", "p_bh", "p_bonferroni", "direction"]
    rows = lambda df: sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect()))
    assert rows(association.theme_comparison(entries, member, ["x", "y"])) == rows(association.group_comparison(pairs, "theme", "m", ["x", "y"]))


def test_correlations_with_missing_values(spark):
    rng = random.Random(8)
    data = [(float(rng.randint(0, 9)), rng.random() if i % 7 else None, rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    rank = lambda v: [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]
    got = {(r.var1, r.var2): (r.r, r.n) for r in association.correlations(df, ["a", "b", "c"], "spearman").collect()}
    for (i, x), (j, y) in (((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))):
        both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        assert got[x, y] == (pytest.approx(np.corrcoef(rank([p for p, _ in both]), rank([q for _, q in both]))[0, 1]), len(both))
    assert association.correlations(df, ["a"], "spearman").count() == association.variable_types(df, []).count() == 0
    assert association.correlations(df, ["a", "b", "c"], pairs=[("a", "c")]).count() == 1


def test_names_of_columns(spark):
    names = themes.syntactic_names(["a b", "a-b", "a.b", "2x", "_u", ".1", "ok"])
    assert names == ["a.b", "a.b.1", "a.b.2", "X2x", "X_u", "X.1", "ok"]
    entries = spark.createDataFrame([(i, float(i), 1.0) for i in range(60)], "std_id long, m double, same double")
    member = spark.createDataFrame([(i, t) for i in range(20) for t in ("a b", "a-b") if i % 2 or t == "a b"] + [(1, "rare")], "std_id long, theme string")
    rows, columns = association.prepared(entries, member, ["m", "same"], ["a b", "a-b", "rare"])
    assert columns == ["m", "theme_membership_a.b", "theme_membership_a.b.1"]
    assert rows.agg(F.sum("`theme_membership_a.b`"), F.sum("`theme_membership_a.b.1`")).first()[:] == (20, 10)


def test_inserts_fail_on_an_unreadable_table(spark, tmp_path):
    """Only a missing table counts as none yet."""
    from loamfield.streaming import live

    spark.createDataFrame([(1, "a")], "id long, v string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part.parquet").write_bytes(b"no parquet file at all")
    stream = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="(?i)parquet"):
        live.inserts(stream, "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["part.parquet"]
