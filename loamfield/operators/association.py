"""Correlations, group tests and co-occurrence of themes, with p-values under three regimes.

Data rows are only ever aggregated; p-values are taken on result rows, which are as many as
there are pairs of variables or themes.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import cleaned, described_values
from ..functions.ranges import with_before
from ..functions.tails import chi_square_upper, correlation_p, fisher_exact, normal_two_sided

# The least observations, members and variance; most values of an ordinal; effect tiers; z of 95 %.
LEAST_OBSERVED, LEAST_MEMBERS, LEAST_VARIANCE, ORDINAL_MOST = 30, 5, 0.001, 21
TIERS = ((0.5, "large"), (0.3, "medium"), (0.10, "small"))
Z95 = 1.959963984540054
EXPECTED_LEAST, ENTRIES_LEAST, OBSERVED_LEAST, NETWORK_LEAST, NETWORK_TOP = 5, 10, 1, 3, 30


@F.pandas_udf(T.DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else correlation_p(float(a), int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else normal_two_sided(x)).astype("float64")


@F.pandas_udf(T.DoubleType())
def _chi_square_p(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else chi_square_upper(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def _fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two columns that are null together; null where one doesn't vary."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def usable_columns(df: DataFrame, metrics: Sequence[str], members: Sequence[str] = ()) -> list[str]:
    """Metrics with enough values and variance, and 0/1 columns with enough members: one aggregate."""
    x = {c: cleaned(F.col(f"`{c}`")) for c in [*metrics, *members]}
    row = df.agg(*(e for c in x for e in (F.count(x[c]).alias(f"n_{c}"), F.var_samp(x[c]).alias(f"v_{c}"), F.sum((x[c] > 0).cast("int")).alias(f"m_{c}")))).first()
    enough = [c for c in metrics if row[f"n_{c}"] >= LEAST_OBSERVED]
    enough += [c for c in members if (row[f"m_{c}"] or 0) >= LEAST_MEMBERS]
    return [c for c in enough if (row[f"v_{c}"] or 0) >= LEAST_VARIANCE]


def variable_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_distinct, kind): binary, ordinal or continuous, by the number of distinct values."""
    if not columns:
        return df.sparkSession.createDataFrame([], "variable string, n_distinct bigint, kind string")
    x = {c: cleaned(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*(F.struct(F.lit(c).alias("variable"), F.countDistinct(x[c]).alias("n_distinct"), F.min(x[c]).alias("low"), F.max(x[c]).alias("high")).alias(c) for c in columns))
    long = row.select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("v")).select("v.*")
    binary = (F.col("n_distinct") <= 2) & (F.coalesce("low", F.lit(0.0)).isin(0.0, 1.0)) & (F.coalesce("high", F.lit(0.0)).isin(0.0, 1.0))
    return long.select("variable", "n_distinct", F.when(binary, "binary").when(F.col("n_distinct") <= ORDINAL_MOST, "ordinal").otherwise("continuous").alias("kind"))


def pair_method(a: str, b: str, n: int, normal: bool) -> str:
    """Pearson for two binaries or a binary and a continuous, Spearman with any ordinal; for two continuous by size and normality."""
    if "ordinal" in (a, b):
        return "spearman"
    if "binary" in (a, b):
        return "pearson"
    return "pearson" if n >= 8 and normal else "spearman"


def average_ranks(df: DataFrame, value: str, to: str, by: Sequence[str] = (), among: DataFrame | None = None) -> DataFrame:
    """``df`` with the mid-rank of ``value`` among its group's values, from 1; null values have none.

    Ranks are taken on distinct values, in ranges, and joined back: no task sorts a whole
    column.  ``among`` has the same rows, if ``df`` is these with more columns: ranks are then
    taken there, so that a plan of many ranks doesn't hold each in the next.
    """
    by = list(by)
    counts = (df if among is None else among).where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    ranks = with_before(counts, "_v", "_m", "_before", by)
    ranks = ranks.select(*by, F.col("_v").alias(value), (F.col("_before") + (F.col("_m") + 1) / 2).alias(to))
    return df.join(ranks, [*by, value], "left")


#: What correlations give, for frames without rows.
FOUND = "var1 string, var2 string, r double, n bigint, method string, p double"


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson", pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(var1, var2, r, n, method, p) of every pair of columns, or of ``pairs`` only, over its complete rows; no rows without a pair.

    Pearson takes all pairs in one aggregate.  Spearman ranks each pair's complete rows; where
    no value is missing each column is ranked once for all pairs.
    """
    pairs = list(combinations(columns, 2)) if pairs is None else list(pairs)
    if not pairs:
        return df.sparkSession.createDataFrame([], FOUND)
    used = [c for c in columns if any(c in p for p in pairs)]
    x = {c: cleaned(F.col(f"`{c}`")) for c in used}
    one = lambda a, b, u, v: F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), correlation(u, v).alias("r"), F.count(u).alias("n"))
    if method == "pearson":
        parts = [df.agg(F.array(*(one(a, b, F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])) for a, b in pairs)).alias("all"))]
    elif df.agg(F.count_if(functools.reduce(Column.__or__, (v.isNull() for v in x.values()))).alias("n")).first()["n"] == 0:
        rows = df.select(*(x[c].alias(f"_{i}") for i, c in enumerate(used)))
        ranked = rows
        for i in range(len(used)):
            ranked = average_ranks(ranked, f"_{i}", f"_r{i}", among=rows)
        rank = {c: F.col(f"_r{i}") for i, c in enumerate(used)}
        parts = [ranked.agg(F.array(*(one(a, b, rank[a], rank[b]) for a, b in pairs)).alias("all"))]
    else:
        parts = []
        for a, b in pairs:
            rows = df.select(x[a].alias("_a"), x[b].alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
            ranked = average_ranks(average_ranks(rows, "_a", "_ra"), "_b", "_rb", among=rows)
            parts.append(ranked.agg(F.array(one(a, b, F.col("_ra"), F.col("_rb"))).alias("all")))
    out = functools.reduce(DataFrame.unionByName, parts).select(F.explode("all").alias("v")).select("v.*")
    return out.select("var1", "var2", F.when(~F.isnan("r"), F.col("r")).alias("r"), "n", F.lit(method).alias("method")).withColumn("p", _correlation_p("r", "n"))


def pair_methods(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], str]:
    """The method that suits each pair, by the variables' kinds and, for two continuous ones, normality."""
    kinds = {r["variable"]: r["kind"] for r in variable_types(df, columns).collect()}
    normal = {}
    for c in (c for c in columns if kinds[c] == "continuous"):
        r = described_values(df, c, ["shapiro_p"]).first()
        normal[c] = (r["shapiro_p"] or 0) > 0.05 and r["n_observed"] >= 8
    both = lambda a, b: normal.get(a, True) and normal.get(b, True)
    return {(a, b): pair_method(kinds[a], kinds[b], 8 if both(a, b) else 0, both(a, b)) for a, b in combinations(columns, 2)}


def dynamic_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations whose method is chosen for each pair; see :func:`pair_methods`."""
    methods = pair_methods(df, columns) if len(columns) > 1 else {}
    parts = [correlations(df, columns, m, [p for p, q in methods.items() if q == m]) for m in ("pearson", "spearman")]
    return parts[0].unionByName(parts[1])


def prepared(entries: DataFrame, membership: DataFrame, metrics: Sequence[str], themes: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Entries with a 0/1 column for each theme, and the columns worth correlating: see :func:`usable_columns`.

    Columns are named after themes; of names that would be one column the later take a number.
    """
    from .themes import PREFIX, syntactic_names, wide

    names = syntactic_names([f"{PREFIX}{t}" for t in themes])
    flags = wide(entries.select("std_id", *metrics), membership, themes).withColumnsRenamed({f"{PREFIX}{t}": n for t, n in zip(themes, names, strict=True)})
    columns = usable_columns(flags, metrics, names) if [*metrics, *names] else []
    return flags.select("std_id", *(f"`{c}`" for c in columns)), columns


def excluded_pairs(columns: Sequence[str], affect: Sequence[str], members: Sequence[str]) -> list[tuple[str, str, bool]]:
    """(row, column, excluded) of the whole matrix of variables: pairs that measure one thing twice, never the diagonal."""
    inside = lambda a, b: a in affect and (b in affect or b in members)
    return [(a, b, a != b and (inside(a, b) or inside(b, a))) for a in columns for b in columns]


def with_adjusted_p(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with p_bh and p_bonferroni over the rows whose p isn't null; a row a test, so one window holds them."""
    tested = F.col(p).isNotNull()
    everything = W.partitionBy(tested)
    up = W.partitionBy(tested).orderBy(p)
    down = W.partitionBy(tested).orderBy(F.desc(p), F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    ranked = df.withColumn("_m", F.count("*").over(everything)).withColumn("_rank", F.row_number().over(up))
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))
    return ranked.withColumns({"p_bh": F.when(tested, bh), "p_bonferroni": F.when(tested, F.least(F.lit(1.0), F.col(p) * F.col("_m")))}).drop("_m", "_rank")


def effect_tier(r: Column) -> Column:
    out = F.lit("negligible")
    for least, name in reversed(TIERS):
        out = F.when(F.abs(r) >= least, name).otherwise(out)
    return F.when(r.isNotNull(), out)


def with_fisher_ci(df: DataFrame, r: str = "r", n: str = "n", method: str = "method") -> DataFrame:
    """``df`` with ci_lower and ci_upper at 95 % by Fisher's z; null with fewer than four pairs or a perfect correlation."""
    x, k = F.col(r), F.col(n)
    se = F.when(F.col(method) == "spearman", F.sqrt((1 + x * x / 2) / (k - 3))).otherwise(1 / F.sqrt(k - 3))
    ok = (k >= 4) & (F.abs(x) < 1)
    return df.withColumns({"ci_lower": F.when(ok, F.tanh(F.atanh(x) - Z95 * se)), "ci_upper": F.when(ok, F.tanh(F.atanh(x) + Z95 * se))})


def significant(found: DataFrame, affect: Sequence[str] = (), members: Sequence[str] = (), least_p: float = 0.05) -> DataFrame:
    """Correlations in long form with tiers, intervals and p-values adjusted over the pairs that aren't circular.

    Pairs within ``affect``, and of affect with ``members``, measure one thing twice: they
    stay in the result, flagged, and count in no adjustment.
    """
    a, b = (F.col("var1"), F.col("var2"))
    circular = (a.isin(*affect) & b.isin(*affect)) | (a.isin(*affect) & b.isin(*members)) | (a.isin(*members) & b.isin(*affect)) if affect else F.lit(False)
    marked = found.where("r IS NOT NULL").withColumn("excluded_from_findings", circular).withColumn("_p", F.when(~F.col("excluded_from_findings"), F.col("p")))
    out = with_fisher_ci(with_adjusted_p(marked, "_p")).drop("_p")
    return out.withColumns({"effect_size": effect_tier(F.col("r")), "significant": F.coalesce(F.col("p_bonferroni") < least_p, F.lit(False))})


def strongest(found: DataFrame, n: int) -> DataFrame:
    return found.where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "var1", "var2").limit(n)


def group_comparison(rows: DataFrame, group: str, member: str, values: Sequence[str], least: int = LEAST_MEMBERS) -> DataFrame:
    """(group, variable, n1, n2, mean_1, mean_2, u, p, effect_r, ...) of a rank-sum test of members against others.

    ``rows`` has a row for each entry and group with a 0/1 ``member``.  The statistic is that of
    members; p is by the normal approximation with corrections for ties and continuity; the
    effect is rank-biserial.  Everything is an aggregate of (value, member) counts.
    """
    long = _long_values(rows.select(F.col(group).alias("group"), F.col(member).cast("int").alias("m"), *values), ["group", "m"], values).where("m IS NOT NULL")
    counts = long.groupBy("group", "variable", "x").agg(F.sum("m").alias("a"), F.count("*").alias("t"))
    sums = average_ranks_of_counts(counts).groupBy("group", "variable").agg(
        F.sum("a").alias("n1"),
        F.sum("t").alias("n"),
        F.sum(F.col("rank") * F.col("a")).alias("ranks"),
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"),
        F.sum(F.col("x") * F.col("a")).alias("s1"),
        F.sum(F.col("x") * F.col("t")).alias("s"),
    )
    return _rank_sum_test(sums, least)


def theme_comparison(entries: DataFrame, membership: DataFrame, values: Sequence[str], least: int = LEAST_MEMBERS) -> DataFrame:
    """As :func:`group_comparison`, of each theme's members among all entries.

    A value's rank among all entries is the same for every theme, so it is taken once, and no
    row is made of an entry and a theme that it is not in.
    """
    long = _long_values(entries, ["std_id"], values)
    ranked = average_ranks_of_counts(long.groupBy(F.lit("all").alias("group"), "variable", "x").agg(F.count("*").alias("t"))).drop("group")
    whole = ranked.groupBy("variable").agg(F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"), F.sum(F.col("x") * F.col("t")).alias("s"))
    members = long.join(membership.select("std_id", F.col("theme").alias("group")).distinct(), "std_id").groupBy("group", "variable", "x").agg(F.count("*").alias("a"))
    inside = members.join(ranked.select("variable", "x", "rank"), ["variable", "x"]).groupBy("group", "variable").agg(F.sum("a").alias("n1"), F.sum(F.col("rank") * F.col("a")).alias("ranks"), F.sum(F.col("x") * F.col("a")).alias("s1"))
    return _rank_sum_test(inside.join(whole, "variable"), least)


def _long_values(rows: DataFrame, keys: list[str], values: Sequence[str]) -> DataFrame:
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), cleaned(F.col(f"`{v}`")).alias("x")) for v in values))).alias("v"))
    return long.select(*keys, "v.variable", "v.x").where("x IS NOT NULL")


def _rank_sum_test(sums: DataFrame, least: int) -> DataFrame:
    """The test of rows (group, variable, n1, n, ranks, ties, s1, s): sizes, ranks and sums of members, and of all."""
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n")
    sums = sums.withColumn("n2", n - n1).withColumns({"mean_1": F.try_divide(F.col("s1"), n1), "mean_2": F.try_divide(F.col("s") - F.col("s1"), n2)})
    sums = sums.where((n1 >= least) & (n2 >= least)).withColumn("u", F.col("ranks") - n1 * (n1 + 1) / 2)
    shift = F.col("u") - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(sigma > 0, (shift - F.signum(shift) * 0.5) / sigma)
    effect = 2 * F.col("u") / (n1 * n2) - 1
    tested = sums.withColumns({"effect_r": effect, "z": z}).withColumn("p", _normal_p("z"))
    direction = F.when(F.col("effect_r") > 0, "Higher in theme").when(F.col("effect_r") < 0, "Lower in theme").otherwise("No difference")
    return with_adjusted_p(tested.withColumn("direction", direction)).withColumn("effect_size", effect_tier(F.col("effect_r"))).drop("ranks", "ties", "z", "n", "s", "s1")


def average_ranks_of_counts(counts: DataFrame) -> DataFrame:
    """Counts (group, variable, x, a, t) with the mid-rank of x among the group's entries."""
    return with_before(counts, "x", "t", "_before", ["group", "variable"]).withColumn("rank", F.col("_before") + (F.col("t") + 1) / 2).drop("_before")


def pair_counts(membership: DataFrame) -> DataFrame:
    """(theme1, theme2, n_both) of every pair of themes that an entry has together.

    Pairs are made within each entry's own set of themes, which the number of themes bounds.
    """
    sets = membership.groupBy("std_id").agg(F.array_sort(F.collect_set("theme")).alias("t"))
    later = F.transform(F.col("t"), lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("theme1"), b.alias("theme2"))))
    return sets.select(F.explode(F.flatten(later)).alias("p")).groupBy("p.theme1", "p.theme2").agg(F.count("*").alias("n_both"))


def cooccurrence(entries: DataFrame, membership: DataFrame, least: int = LEAST_MEMBERS) -> DataFrame:
    """(theme1, theme2, n_both, n1, n2, n, test, statistic, phi, cramers_v, p, ...) of pairs of themes seen together.

    Themes have at least ``least`` members, pairs at least one common entry.  With an expected
    count under five the test is Fisher's and the statistic phi squared times n; else it is
    chi-square without continuity correction.
    """
    n = entries.agg(F.countDistinct("std_id").alias("n"))
    sizes = membership.groupBy("theme").agg(F.countDistinct("std_id").alias("k")).where(F.col("k") >= least)
    pairs = pair_counts(membership).where(F.col("n_both") >= OBSERVED_LEAST)
    pairs = pairs.join(sizes.select(F.col("theme").alias("theme1"), F.col("k").alias("n1")), "theme1").join(sizes.select(F.col("theme").alias("theme2"), F.col("k").alias("n2")), "theme2")
    pairs = pairs.crossJoin(F.broadcast(n)).where(F.col("n") >= ENTRIES_LEAST)  # n is one row
    a = F.col("n_both")
    b, c = F.col("n1") - a, F.col("n2") - a
    d = F.col("n") - F.col("n1") - F.col("n2") + a
    not1, not2 = F.col("n") - F.col("n1"), F.col("n") - F.col("n2")
    cells = (F.col("n1") * F.col("n2"), F.col("n1") * not2, not1 * F.col("n2"), not1 * not2)
    small = F.least(*cells) / F.col("n") < EXPECTED_LEAST
    margins = F.sqrt(F.col("n1").cast("double") * F.col("n2") * not1 * not2)
    phi = F.when(margins > 0, (a * d - b * c) / margins)
    out = pairs.withColumns({"phi": phi, "test": F.when(small, "fisher").otherwise("chi_square")}).withColumn("statistic", F.col("phi") * F.col("phi") * F.col("n"))
    out = out.withColumns({"cramers_v": F.sqrt(F.col("statistic") / F.col("n")), "p": F.when(F.col("test") == "fisher", _fisher_p(a, b, c, d)).otherwise(_chi_square_p("statistic"))})
    return with_adjusted_p(out)


def network(membership: DataFrame, least: int = NETWORK_LEAST, top: int = NETWORK_TOP) -> DataFrame:
    """(theme1, theme2, n_both) among the ``top`` themes by weighted degree, isolated ones left out."""
    edges = pair_counts(membership).where(F.col("n_both") >= least)
    ends = edges.select(F.col("theme1").alias("theme"), "n_both").unionByName(edges.select(F.col("theme2").alias("theme"), "n_both"))
    best = ends.groupBy("theme").agg(F.sum("n_both").alias("degree")).orderBy(F.desc("degree"), "theme").limit(top).select("theme")
    return edges.join(best.withColumnRenamed("theme", "theme1"), "theme1", "left_semi").join(best.withColumnRenamed("theme", "theme2"), "theme2", "left_semi")
