"""Queries on the metric catalogue, correlations, tests and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import agreement, association
from .registry import query, table


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


_X = "l_extendedprice"


@query("""
SELECT l_returnflag, count(*) AS n_observed, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(stddev_samp(x), 4) AS sd, round(1.4826 * mad(x), 4) AS mad,
       round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr, round(max(x) - min(x), 4) AS range_width, round(stddev_samp(x) / avg(x), 4) AS cv, round(min(x), 4) AS min, round(max(x), 4) AS max
FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY l_returnflag
""")
def metric_location_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["mean", "median", "sd", "mad", "iqr", "range_width", "cv", "min", "max"]
    return _rounded(metrics.described_values(table(spark, sf_dir, "lineitem"), _X, wanted, ["l_returnflag"]), 4)


@query("""
SELECT l_linestatus, count(*) AS n_observed, round(quantile_cont(x, 0.1), 4) AS p10, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.75), 4) AS p75,
       round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99, round(quantile_cont(x, 0.333), 4) AS quantile
FROM (SELECT l_linestatus, l_extendedprice AS x FROM lineitem) GROUP BY l_linestatus
""")
def metric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["p10", "p25", "p75", "p90", "p95", "p99", ("quantile", {"q": 0.333})]
    return _rounded(metrics.described_values(table(spark, sf_dir, "lineitem"), _X, wanted, ["l_linestatus"]), 4)


@query("""
WITH x AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS x FROM lineitem), m AS (SELECT g, avg(x) AS m FROM x GROUP BY g),
p AS (SELECT g, count(*) AS n, count(DISTINCT x) AS u, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM x JOIN m USING (g) GROUP BY g)
SELECT g AS l_returnflag, n AS n_observed, n, u AS n_unique, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis_excess FROM p
""")
def metric_shape_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.described_values(table(spark, sf_dir, "lineitem"), "l_quantity", ["n", "n_unique", "skewness", "kurtosis_excess"], ["l_returnflag"]))


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_type, count(value) AS n_observed, round(CASE WHEN min(value) >= 0 THEN avg(ln(1 + greatest(value, 0))) END, 6) AS log_mean, round(CASE WHEN min(value) >= 0 THEN stddev_samp(ln(1 + greatest(value, 0))) END, 6) AS log_sd,
       count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outlier_count_iqr, round(max(value) / quantile_cont(value, 0.5), 6) AS max_to_median_ratio
FROM events JOIN q USING (event_type) GROUP BY event_type
""")
def metric_heavy_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.described_values(table(spark, sf_dir, "events"), "value", ["log_mean", "log_sd", "outlier_count_iqr", "max_to_median_ratio"], ["event_type"]))


@query("""
SELECT l_returnflag, count(*) AS n_observed, round(avg((x = 0)::INT), 6) AS proportion_zero, round(avg((x <> 0)::INT), 6) AS proportion_nonzero, round(avg((x > 0.05)::INT), 6) AS proportion_above,
       round(avg((x < 0.05)::INT), 6) AS proportion_below, round(avg((x BETWEEN 0.02 AND 0.06)::INT), 6) AS proportion_in_range FROM (SELECT l_returnflag, l_discount AS x FROM lineitem) GROUP BY 1
""")
def metric_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["proportion_zero", "proportion_nonzero", ("proportion_above", {"threshold": 0.05}), ("proportion_below", {"threshold": 0.05}), ("proportion_in_range", {"low": 0.02, "high": 0.06})]
    return _rounded(metrics.described_values(table(spark, sf_dir, "lineitem"), "l_discount", wanted, ["l_returnflag"]))


@query("SELECT p_size, count(p_brand) AS n_observed, round(entropy(p_brand), 6) AS entropy FROM part GROUP BY p_size")
def metric_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.described_values(table(spark, sf_dir, "part"), "p_brand", ["entropy"], ["p_size"]))


@query("""
WITH c AS (SELECT l_returnflag, l_quantity AS label, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, label)::INT AS place FROM c QUALIFY place <= 3
""")
def metric_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_values(table(spark, sf_dir, "lineitem"), "l_quantity", 3, ["l_returnflag"])


@query("SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def metric_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frequencies(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, arg_max(l_quantity, (n, -l_quantity))::DOUBLE AS mode_value, sum(n)::BIGINT AS n_observed FROM c GROUP BY 1
""")
def metric_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.described_values(table(spark, sf_dir, "lineitem"), "l_quantity", ["mode_value"], ["l_returnflag"])


@query()
def shapiro_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normality of a metric by group."""
    return _rounded(metrics.described_values(table(spark, sf_dir, "customer"), "c_acctbal", ["shapiro_p"], ["c_mktsegment"]), 9)


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) <= 2 AND min({c}) IN (0, 1) AND max({c}) IN (0, 1) THEN 'binary' WHEN count(DISTINCT {c}) <= 21 THEN 'ordinal' ELSE 'continuous' END AS kind FROM lineitem" for c in _COLUMNS))
def variable_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.variable_types(table(spark, sf_dir, "lineitem"), _COLUMNS)


_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, 'pearson' AS method FROM lineitem" for a, b in _PAIRS))
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(association.correlations(table(spark, sf_dir, "lineitem"), _COLUMNS).drop("p"))


_RANKS = "SELECT '{a}' AS var1, '{b}' AS var2, round(corr(ra, rb), 6) AS r, count(*) AS n, 'spearman' AS method FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(" UNION ALL ".join(_RANKS.format(a=a, b=b) for a, b in _PAIRS))
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = association.correlations(table(spark, sf_dir, "lineitem"), _COLUMNS, "spearman")
    return _rounded(found.drop("p"))


@query("""
WITH c AS (SELECT unnest([0.001, 0.01, 0.02, 0.02, 0.04, 0.2, 0.9]) AS p, unnest(range(7)) AS i), k AS (SELECT *, row_number() OVER (ORDER BY p, i) AS r, count(*) OVER () AS m FROM c)
SELECT i::BIGINT AS i, p::DOUBLE AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9)::DOUBLE AS p_bh, round(least(1, p * m), 9)::DOUBLE AS p_bonferroni FROM k
""")
def p_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [0.001, 0.01, 0.02, 0.02, 0.04, 0.2, 0.9]
    rows = spark.range(len(values)).select(F.col("id").alias("i"), F.element_at(F.array(*map(F.lit, values)), F.col("id").cast("int") + 1).alias("p"))
    return association.with_adjusted_p(rows).withColumns({c: F.round(c, 9) for c in ("p_bh", "p_bonferroni")})


@query("""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)
SELECT round(r, 6) AS r, n, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_lower, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS ci_upper FROM c
""")
def fisher_z_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = association.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return _rounded(association.with_fisher_ci(found).select("r", "n", "ci_lower", "ci_upper"))


@query()
def significant_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs by the method that suits them, with tiers, intervals and p-values adjusted over the pairs that aren't circular."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 97).alias("region"))
    return _rounded(association.significant(association.dynamic_correlations(orders, orders.columns), ["o_totalprice", "region"]), 9)


_WILCOXON = """
WITH d AS (SELECT lang, n_chars::DOUBLE AS x, quality AS m FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS k FROM d)
SELECT lang AS "group", 'n_chars' AS variable, sum(m)::BIGINT AS n1, sum(1 - m)::BIGINT AS n2, round(sum(k * m) - sum(m) * (sum(m) + 1) / 2, 3)::DOUBLE AS u,
       round(2 * (sum(k * m) - sum(m) * (sum(m) + 1) / 2) / (sum(m) * sum(1 - m)) - 1, 6)::DOUBLE AS effect_r, round(avg(x) FILTER (m = 1), 4) AS mean_1, round(avg(x) FILTER (m = 0), 4) AS mean_2
FROM r GROUP BY lang HAVING sum(m) >= 5 AND sum(1 - m) >= 5
"""


@query(_WILCOXON)
def wilcoxon_rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = association.group_comparison(rows, "lang", "quality", ["n_chars"])
    return out.select("group", "variable", "n1", "n2", F.round("u", 3).alias("u"), F.round("effect_r", 6).alias("effect_r"), F.round("mean_1", 4).alias("mean_1"), F.round("mean_2", 4).alias("mean_2"))


_BASKETS = "(SELECT DISTINCT l_orderkey AS std_id, p_brand AS theme FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("std_id"), F.col("p_brand").alias("theme")).distinct()


@query(f"WITH m AS {_BASKETS} SELECT a.theme AS theme1, b.theme AS theme2, count(*) AS n_both FROM m a JOIN m b ON a.std_id = b.std_id AND a.theme < b.theme GROUP BY ALL")
def theme_cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.pair_counts(_baskets(spark, sf_dir))


@query(f"""
WITH m AS {_BASKETS}, n AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders), s AS (SELECT theme, count(*) AS k FROM m GROUP BY 1 HAVING k >= 5),
p AS (SELECT a.theme AS theme1, b.theme AS theme2, count(*) AS n_both FROM m a JOIN m b ON a.std_id = b.std_id AND a.theme < b.theme GROUP BY ALL),
q AS (SELECT p.*, x.k AS n1, y.k AS n2, n.n, x.k::DOUBLE * y.k / n.n AS e11, x.k::DOUBLE * (n.n - y.k) / n.n AS e12, (n.n - x.k)::DOUBLE * y.k / n.n AS e21, (n.n - x.k)::DOUBLE * (n.n - y.k) / n.n AS e22
      FROM p JOIN s x ON theme1 = x.theme JOIN s y ON theme2 = y.theme, n),
f AS (SELECT *, (n_both::DOUBLE * (n - n1 - n2 + n_both) - (n1 - n_both)::DOUBLE * (n2 - n_both)) / sqrt(n1::DOUBLE * n2 * (n - n1) * (n - n2)) AS phi FROM q)
SELECT theme1, theme2, n_both, n1, n2, n, CASE WHEN least(e11, e12, e21, e22) < 5 THEN 'fisher' ELSE 'chi_square' END AS test, round(phi * phi * n, 6) AS statistic, round(phi, 6) AS phi, round(abs(phi), 6) AS cramers_v FROM f
""")
def chi_square_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("std_id"))
    return _rounded(association.cooccurrence(orders, _baskets(spark, sf_dir)).drop("p", "p_bh", "p_bonferroni"))


@query(f"""
WITH m AS {_BASKETS}, p AS (SELECT a.theme AS theme1, b.theme AS theme2, count(*) AS n_both FROM m a JOIN m b ON a.std_id = b.std_id AND a.theme < b.theme GROUP BY ALL HAVING count(*) >= 3),
d AS (SELECT theme, sum(n_both) AS degree FROM (SELECT theme1 AS theme, n_both FROM p UNION ALL SELECT theme2, n_both FROM p) GROUP BY 1 ORDER BY degree DESC, theme LIMIT 10)
SELECT p.* FROM p WHERE theme1 IN (SELECT theme FROM d) AND theme2 IN (SELECT theme FROM d)
""")
def theme_network_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.network(_baskets(spark, sf_dir), top=10)


@query("SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS n_agree, round(avg((quality = toxic)::INT), 6) AS agreement FROM labels")
def percent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").select(F.array(F.col("quality").cast("string")).alias("a"), F.array(F.col("toxic").cast("string")).alias("b"))
    return _rounded(agreement.percent_agreement(pairs))


@query("""
WITH r AS (SELECT avg((quality = toxic)::INT) AS o, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e, count(*) AS n FROM labels)
SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM r
""")
def kappa_two_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


def _rater_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    good, long_ = F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("n_chars") > 1500, F.lit("long"))
    return docs.select(F.col("doc_id").alias("std_id"), F.array_compact(F.array(good, F.col("lang"))).alias("a"), F.array_compact(F.array(long_, F.col("lang"))).alias("b"))


@query("""
WITH s AS (SELECT doc_id, list_sort(list_filter([CASE WHEN quality = 1 THEN 'good' END, lang], lambda x: x IS NOT NULL)) AS a, list_sort(list_filter([CASE WHEN n_chars > 1500 THEN 'long' END, lang], lambda x: x IS NOT NULL)) AS b FROM documents JOIN labels USING (doc_id)),
o AS (SELECT count(*) AS n, avg(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) AS o FROM s),
p AS (SELECT a AS v, row_number() OVER () AS i FROM (SELECT a FROM s UNION ALL SELECT b FROM s)),
e AS (SELECT avg(1 - len(list_intersect(x.v, y.v)) / len(list_distinct(list_concat(x.v, y.v)))) AS e FROM p x JOIN p y ON x.i < y.i)
SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round(1 - o / e, 6) AS alpha FROM o, e
""")
def set_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.set_alpha(_rater_sets(spark, sf_dir)))


@query("""
WITH p AS (SELECT quality AS a, toxic AS b FROM labels), v AS (SELECT a AS v FROM p UNION ALL SELECT b FROM p), k AS (SELECT v, count(*) AS k FROM v GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS n, round(1 - (SELECT avg((a <> b)::INT) FROM p) / (1 - (sum(k * k) - sum(k)) / (sum(k) * (sum(k) - 1))), 6) AS alpha FROM k
""")
def nominal_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.nominal_alpha(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("""
WITH s AS (SELECT quality = 1 AS ga, n_chars > 1500 AS lb, lang FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n FROM s),
c AS (SELECT 'good' AS code, avg((NOT ga)::INT) AS o, avg(ga::INT) AS pa, 0 AS pb FROM s UNION ALL SELECT 'long', avg((NOT lb)::INT), 0, avg(lb::INT) FROM s
      UNION ALL SELECT l.lang, 1, avg((s.lang = l.lang)::INT), avg((s.lang = l.lang)::INT) FROM s, (SELECT DISTINCT lang FROM s) l GROUP BY l.lang)
SELECT count(*) AS n_codes, round(avg((o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb)))), 6) AS kappa FROM c WHERE pa + pb > 0 AND pa * pb + (1 - pa) * (1 - pb) < 1
""")
def mean_code_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.mean_code_kappa(_rater_sets(spark, sf_dir)))


@query()
def bootstrap_alpha_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of alpha for a verification sample of 40 documents: the sample is the feature."""
    return _rounded(agreement.bootstrap_alpha(agreement.sampled(_rater_sets(spark, sf_dir), "std_id", 40)))
