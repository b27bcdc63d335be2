"""Queries on associations with their p-values, runs, clusterings, settings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, temporal
from ..operators import association, comparison, coverage, hierarchy, lifecycle, themes
from ..sources import codebooks, config, ingest
from .corpus import _MEMBERS, _entries, _membership
from .registry import query, table
from .runs import _NODES, _brands, _tree
from .statistics import _BASKETS, _RANKS, _WILCOXON, _baskets, _rounded


def _simpson(f: str, a: str, b: str, n: int = 2000) -> str:
    """SQL of the integral of ``f``, in x, from ``a`` to ``b`` by Simpson's rule."""
    x = f"({a}) + i * (({b}) - ({a})) / {n}"
    return f"(list_sum(list_transform(range({n + 1}), lambda i: (CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('@', x)}))) * (({b}) - ({a})) / {3 * n})"


def _normal_p(z: str) -> str:
    """SQL of the two-sided tail of the normal distribution."""
    return f"(2 * {_simpson('exp(-0.5 * pow(@, 2))', f'abs({z})', f'abs({z}) + 12')} / sqrt(2 * pi()))"


def _r_p(r: str, n: str) -> str:
    """SQL of the two-sided p-value of a correlation: the t density's tail, as powers of a cosine up from the angle whose sine is r."""
    power, width = f"({n} - 3)", f"least(pi() / 2, 30 / sqrt({n} - 2.0))"
    f = f"pow(greatest(cos(@), 0), {power})"
    return f"({_simpson(f, f'asin(abs({r}))', f'least(pi() / 2, asin(abs({r})) + {width})')} / {_simpson(f, '0', width)})"


_ADJUSTED = """SELECT *, CASE WHEN tested THEN round(least(1, min(p * m / rank) OVER (PARTITION BY tested ORDER BY p DESC, rank DESC ROWS UNBOUNDED PRECEDING)), 6) END::DOUBLE AS p_bh, CASE WHEN tested THEN round(least(1, p * m), 6) END::DOUBLE AS p_bonferroni
FROM (SELECT *, count(*) OVER (PARTITION BY tested) AS m, row_number() OVER (PARTITION BY tested ORDER BY p) AS rank FROM {rows})"""

_LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_PAIRS = [(a, b) for i, a in enumerate(_LINES) for b in _LINES[i + 1 :]]
_PEARSON = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _LINE_PAIRS)
_SPEARMAN = " UNION ALL ".join(_RANKS.format(a=a, b=b).replace("round(corr(ra, rb), 6)", "corr(ra, rb)") for a, b in _LINE_PAIRS)


@query(f"SELECT var1, var2, round({_r_p('r', 'n')}, 6) AS p, 'pearson' AS method FROM ({_PEARSON}) UNION ALL SELECT var1, var2, round({_r_p('r', 'n')}, 6), 'spearman' FROM ({_SPEARMAN})")
def correlation_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of all pairs by both methods."""
    lines = table(spark, sf_dir, "lineitem")
    both = association.correlations(lines, _LINES).unionByName(association.correlations(lines, _LINES, "spearman"))
    return _rounded(both.select("var1", "var2", "p", "method"))


@query(f"""
WITH c AS (SELECT *, {_r_p('r', 'n')} AS p, var1 IN ('l_quantity', 'l_extendedprice') AND var2 IN ('l_quantity', 'l_extendedprice') AS excluded FROM ({_PEARSON})), t AS (SELECT *, NOT excluded AS tested FROM c), a AS ({_ADJUSTED.format(rows='t')})
SELECT var1, var2, round(r, 6) AS r, excluded AS excluded_from_findings, p_bh, p_bonferroni, CASE WHEN abs(r) >= 0.5 THEN 'large' WHEN abs(r) >= 0.3 THEN 'medium' WHEN abs(r) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect_size,
       round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_lower, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS ci_upper, coalesce(p_bonferroni < 0.05, false) AS significant FROM a
""")
def significant_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations in a report's form: circular pairs flagged and left out of the adjustment, tiers, intervals."""
    found = association.significant(association.correlations(table(spark, sf_dir, "lineitem"), _LINES), ["l_quantity", "l_extendedprice"])
    return _rounded(found.drop("n", "method", "p"))


@query(f"SELECT var1, var2, round(r, 6) AS r FROM ({_SPEARMAN}) ORDER BY abs(r) DESC, var1, var2 LIMIT 2")
def spearman_ci_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two strongest pairs by ranks: a lollipop chart's rows."""
    return _rounded(association.strongest(association.correlations(table(spark, sf_dir, "lineitem"), _LINES, "spearman"), 2).select("var1", "var2", "r"))


@query(f"SELECT var1, var2, round(tanh(atanh(r) - 1.959963984540054 * sqrt((1 + r * r / 2) / (n - 3))), 6) AS ci_lower, round(tanh(atanh(r) + 1.959963984540054 * sqrt((1 + r * r / 2) / (n - 3))), 6) AS ci_upper FROM ({_SPEARMAN})")
def spearman_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of rank correlations, whose standard error is a wider one."""
    found = association.correlations(table(spark, sf_dir, "lineitem"), _LINES, "spearman")
    return _rounded(association.with_fisher_ci(found).select("var1", "var2", "ci_lower", "ci_upper"))


@query("""
WITH k AS (SELECT 'l_discount' AS v, 'ordinal' AS kind UNION ALL SELECT 'l_extendedprice', 'continuous' UNION ALL SELECT 'l_tax', 'ordinal' UNION ALL SELECT 'returned', 'binary')
SELECT a.v AS var1, b.v AS var2, CASE WHEN 'ordinal' IN (a.kind, b.kind) THEN 'spearman' ELSE 'pearson' END AS method FROM k a JOIN k b ON a.v < b.v
""")
def pair_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which correlation suits each pair of variables of three kinds."""
    rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_extendedprice", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    found = association.dynamic_correlations(rows, rows.columns)
    return found.select("var1", "var2", "method")


@query("SELECT NULL::VARCHAR AS var1, NULL::VARCHAR AS var2, NULL::DOUBLE AS r, 0 AS n, '' AS method, NULL::DOUBLE AS p, '' AS effect_size FROM region WHERE false")
def correlations_of_one_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than two variables: no rows, and every column that there would be."""
    one = table(spark, sf_dir, "lineitem").select("l_quantity")
    parts = [association.correlations(one, c, m) for c in ([], ["l_quantity"]) for m in ("pearson", "spearman")] + [association.dynamic_correlations(one, ["l_quantity"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return association.significant(out).select("var1", "var2", "r", "n", "method", "p", "effect_size")


@query(f"""
WITH {_MEMBERS}, w AS (SELECT doc_id, n_chars, coalesce(max((theme = 'legal')::INT), 0) AS a, coalesce(max((theme = 'english')::INT), 0) AS b FROM documents LEFT JOIN m ON doc_id = std_id GROUP BY ALL),
u AS (SELECT 'n_chars' AS variable, sum(n_chars) AS total, count(n_chars) >= 30 AND var_samp(n_chars) >= 0.001 AS keep FROM w UNION ALL SELECT 'theme_membership_legal', sum(a), sum(a) >= 5 AND var_samp(a) >= 0.001 FROM w UNION ALL SELECT 'theme_membership_english', sum(b), sum(b) >= 5 AND var_samp(b) >= 0.001 FROM w)
SELECT variable, total::DOUBLE AS total FROM u WHERE keep
""")
def correlation_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and membership columns worth correlating: one without members, a constant and a sparse one fall out."""
    entries = _entries(spark, sf_dir).withColumns({"same": F.lit(1.0), "sparse": F.when(F.col("std_id") < 3, 1.0)})
    rows, columns = association.prepared(entries, _membership(spark, sf_dir), ["n_chars", "same", "sparse"], ["legal", "english", "no such theme"])
    total = rows.agg(F.array(*(F.struct(F.lit(c).alias("variable"), F.sum(c).cast("double").alias("total")) for c in columns)).alias("a"))
    return total.select(F.explode("a").alias("x")).select("x.*")


@query("""
WITH v AS (SELECT unnest(['score', 'intensity', 'theme_a', 'n_chars']) AS v)
SELECT a.v AS row_name, b.v AS column_name, a.v <> b.v AND ((a.v IN ('score', 'intensity') AND b.v <> 'n_chars') OR (b.v IN ('score', 'intensity') AND a.v <> 'n_chars')) AS excluded FROM v a, v b
""")
def correlation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a correlation matrix that measure one thing twice."""
    cells = association.excluded_pairs(["score", "intensity", "theme_a", "n_chars"], ["score", "intensity"], ["theme_a"])
    return spark.createDataFrame(cells, "row_name string, column_name string, excluded boolean")


@query("SELECT unnest(['theme_a.b', 'theme_a.b.1', 'X1st', 'ok_name', '.5'  || 'x']) AS name, unnest([0, 1, 2, 3, 4]) AS i".replace("'.5'  || 'x'", "'X.5x'"))
def syntactic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names of themes that differ in punctuation only stay apart."""
    return spark.createDataFrame(list(enumerate(themes.syntactic_names(["theme_a b", "theme_a-b", "1st", "ok_name", ".5x"]))), "i int, name string")


_W_P = _normal_p("((u - n1 * n2 / 2) - sign(u - n1 * n2 / 2) * 0.5) / nullif(sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))), 0)")


@query(f"""
WITH d AS (SELECT lang, n_chars::DOUBLE AS x, quality AS m FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS k FROM d),
t AS (SELECT lang, sum(pow(c, 3) - c) AS ties FROM (SELECT lang, x, count(*) AS c FROM d GROUP BY ALL) GROUP BY 1),
g AS (SELECT lang, sum(m) AS n1, sum(1 - m) AS n2, count(*) AS n, sum(k * m) - sum(m) * (sum(m) + 1) / 2 AS u FROM r GROUP BY lang HAVING sum(m) >= 5 AND sum(1 - m) >= 5),
p AS (SELECT lang AS "group", {_W_P} AS p, true AS tested FROM g JOIN t USING (lang)), a AS ({_ADJUSTED.format(rows='p')})
SELECT "group", round(p, 6) AS p, p_bh, p_bonferroni FROM a
""")
def wilcoxon_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(association.group_comparison(rows, "lang", "quality", ["n_chars"]).select("group", "p", "p_bh", "p_bonferroni"))


@query("""
WITH d AS (SELECT doc_id, lang, source, n_chars::DOUBLE AS x FROM documents), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS k FROM d), t AS (SELECT count(*) AS n, sum(x) AS s FROM d),
g AS (SELECT lang AS "group", count(*) AS n1, sum(k) - count(*) * (count(*) + 1) / 2 AS u, avg(x) AS mean_1, sum(x) AS s1 FROM r GROUP BY lang)
SELECT "group", n1, n - n1 AS n2, round(u, 3)::DOUBLE AS u, round(2 * u / (n1 * (n - n1)) - 1, 6)::DOUBLE AS effect_r, round(mean_1, 4) AS mean_1, round((s - s1) / (n - n1), 4) AS mean_2 FROM g, t WHERE n1 >= 5 AND n - n1 >= 5
""")
def themes_against_the_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of each language's documents against those of all others."""
    docs = table(spark, sf_dir, "documents").withColumn("std_id", F.col("doc_id"))
    out = association.theme_comparison(docs, docs.select("std_id", F.col("lang").alias("theme")), ["n_chars"])
    return out.select("group", "n1", "n2", F.round("u", 3).alias("u"), F.round("effect_r", 6).alias("effect_r"), F.round("mean_1", 4).alias("mean_1"), F.round("mean_2", 4).alias("mean_2"))


_C = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
_H = f"exp({_C.format(n='n1', k='x')} + {_C.format(n='(n - n1)', k='(n2 - x)')} - {_C.format(n='n', k='n2')})"


@query(f"""
WITH m AS {_BASKETS}, o AS (SELECT count(DISTINCT o_orderkey)::DOUBLE AS n FROM orders), s AS (SELECT theme, count(*)::DOUBLE AS k FROM m GROUP BY 1 HAVING k >= 5),
p AS (SELECT a.theme AS theme1, b.theme AS theme2, count(*)::DOUBLE AS nb FROM m a JOIN m b ON a.std_id = b.std_id AND a.theme < b.theme GROUP BY ALL),
q AS (SELECT p.*, x.k AS n1, y.k AS n2, o.n FROM p JOIN s x ON theme1 = x.theme JOIN s y ON theme2 = y.theme, o),
f AS (SELECT *, (nb * (n - n1 - n2 + nb) - (n1 - nb) * (n2 - nb)) / sqrt(n1 * n2 * (n - n1) * (n - n2)) AS phi, least(n1 * n2, n1 * (n - n2), (n - n1) * n2, (n - n1) * (n - n2)) / n < 5 AS small FROM q),
h AS (SELECT theme1, theme2, list(h) AS hs, max(h) FILTER (x = nb) AS own FROM (SELECT theme1, theme2, nb, x, {_H} AS h FROM (SELECT *, unnest(range(greatest(0, n1 + n2 - n)::BIGINT, least(n1, n2)::BIGINT + 1)) AS x FROM f WHERE small)) GROUP BY ALL),
t AS (SELECT f.theme1, f.theme2, CASE WHEN small THEN list_sum(list_filter(hs, lambda v: v <= own * (1 + 1e-7))) ELSE {_normal_p('abs(phi) * sqrt(n)')} END AS p, true AS tested FROM f LEFT JOIN h USING (theme1, theme2)), a AS ({_ADJUSTED.format(rows='t')})
SELECT theme1, theme2, round(p, 6) AS p, p_bh, p_bonferroni FROM a
""")
def cooccurrence_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of pairs of themes by chi-square or Fisher's test, under three regimes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("std_id"))
    return _rounded(association.cooccurrence(orders, _baskets(spark, sf_dir)).select("theme1", "theme2", "p", "p_bh", "p_bonferroni"))


# --- runs -----------------------------------------------------------------------------------


@query("SELECT dense_rank() OVER (ORDER BY year(o_orderdate)) AS run_idx, year(o_orderdate)::VARCHAR AS run_id, o_orderpriority AS name, count(*) AS entry_count FROM orders GROUP BY year(o_orderdate), o_orderpriority")
def theme_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("string").alias("run_id"), F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("entry_count"))
    return comparison.theme_timeline(rows)


_MODELS = "r AS (SELECT 'run_' || lpad(n_nationkey::VARCHAR, 3, '0') AS run_id, 'p' || n_regionkey AS provider, 'm' || (n_nationkey // 20) AS model, CASE WHEN n_nationkey % 4 = 0 THEN '0.9' ELSE '1.' || n_nationkey END AS schema_version FROM nation)"


def _model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("run_"), F.lpad(key.cast("string"), 3, "0")).alias("run_id"),
        F.concat(F.lit("p"), "n_regionkey").alias("provider"),
        F.concat(F.lit("m"), F.floor(key / 20).cast("string")).alias("model"),
        F.when(key % 4 == 0, "0.9").otherwise(F.concat(F.lit("1."), key.cast("string"))).alias("schema_version"),
    )


@query(f"""
WITH {_MODELS}, l AS (SELECT * FROM r ORDER BY run_id DESC LIMIT 1), o AS (SELECT max(r.run_id) AS run_id FROM r, l WHERE r.run_id < l.run_id AND (r.provider <> l.provider OR r.model <> l.model)),
c AS (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS i FROM r WHERE schema_version LIKE '1.%' ORDER BY run_id DESC LIMIT 2)
SELECT 'models' AS kind, run_id, 'current' AS role FROM l UNION ALL SELECT 'models', run_id, 'previous' FROM o UNION ALL SELECT 'runs', run_id, CASE i WHEN 1 THEN 'current' ELSE 'previous' END FROM c
""")
def runs_to_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which two runs are compared: the newest of a readable schema, and the newest with the latest of another model."""
    rows = _model_runs(spark, sf_dir)
    models = comparison.cross_model_pair(rows).select(F.lit("models").alias("kind"), "run_id", "role")
    return models.unionByName(comparison.current_and_previous(rows).select(F.lit("runs").alias("kind"), "run_id", "role"))


@query(f"WITH {_MODELS} SELECT run_id, schema_version LIKE '1.%' AS compatible FROM r")
def compatible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_runs(spark, sf_dir).select("run_id", comparison.compatible_schema(F.col("schema_version")).alias("compatible"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) <= 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) > 1996)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (b.k IS NULL) AS n_first, count(*) FILTER (a.k IS NULL) AS n_second, count(*) AS n_either FROM a FULL JOIN b ON a.k = b.k
""")
def id_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return comparison.set_sizes(orders.where("y <= 1996"), orders.where("y > 1996"), ["k"])


_CODES = "SELECT DISTINCT CASE WHEN p_size % 5 = {c} THEN p_brand || ' x' ELSE p_brand END AS t FROM part WHERE p_size % 7 <> {c}"


@query(f"SELECT a.t AS a, b.t AS b, round(jaro_similarity(lower(a.t), lower(b.t)), 6) AS score FROM ({_CODES.format(c=1)}) a, ({_CODES.format(c=2)}) b")
def scored_code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every pair of two codebooks' codes."""
    out = comparison.scored_code_pairs(_brands(spark, sf_dir, 1), _brands(spark, sf_dir, 2))
    return out.select("a", "b", F.round("score", 6).alias("score"))


@query("""
WITH n AS (SELECT r_name, lower(n_name) AS c, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey), b AS (SELECT r_name AS b, list(c) AS cb FROM n GROUP BY 1), a AS (SELECT lower(r_name) AS a, list(c) AS ca FROM n WHERE k % 5 <> 0 GROUP BY 1),
s AS (SELECT a, b, jaro_similarity(a, lower(b)) AS name_sim, len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))) AS code_jaccard FROM a, b)
SELECT a, b, round(name_sim, 6) AS name_sim, round(code_jaccard, 6) AS code_jaccard, round(greatest(code_jaccard, 0.3 * name_sim + 0.7 * code_jaccard), 6) AS score FROM s
""")
def scored_theme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    now = rows.groupBy(F.col("r_name").alias("name")).agg(F.collect_set("n_name").alias("codes"))
    then = rows.where("n_nationkey % 5 <> 0").groupBy(F.lower("r_name").alias("name")).agg(F.collect_set("n_name").alias("codes"))
    return _rounded(comparison.scored_theme_pairs(then, now).drop("i", "j"))


@query("SELECT theme, count(*) AS n_entries, min(o_orderdate)::DATE AS first_seen FROM (SELECT o_orderpriority || '/' || o_orderstatus AS theme, o_orderdate FROM orders) GROUP BY theme ORDER BY first_seen, theme LIMIT 10")
def earliest_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten themes that came up first: a report's list."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("std_id"), F.col("o_orderdate").alias("ts"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("theme"))
    born = orders.groupBy("theme").agg(F.min(F.struct("ts", "std_id")).alias("b")).select("theme", F.col("theme").alias("code"), F.col("b.std_id").alias("birth_id"))
    out = temporal.emergence(orders, orders, born, "ts")
    return out.orderBy("first_seen", "theme").limit(10).select("theme", "n_entries", F.to_date("first_seen").alias("first_seen"))


@query("SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY ALL")
def theme_month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each theme by month."""
    return metrics.entries_by_month(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus"])


# --- hierarchies and clusterings ------------------------------------------------------------


@query("SELECT s_suppkey AS code_key, r_name AS theme, n_name AS subtheme FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def code_to_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_suppkey").alias("code_key"))
    return hierarchy.code_to_theme(_tree(spark, sf_dir), codes)


@query(f"WITH RECURSIVE {_NODES}, t AS (SELECT id, name, 1 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.name || '/' || n.name, t.depth + 1 FROM nodes n JOIN t ON n.parent = t.id) SELECT id AS node, name AS path FROM t")
def hierarchy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("node", F.array_join("names", "/").alias("path"))


@query("""
WITH a AS (SELECT string_agg(s, '|' ORDER BY s) AS c, max(k) = 1 AS i FROM (SELECT string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) AS s, count(*) AS k FROM nation GROUP BY n_regionkey)),
b AS (SELECT string_agg(n_nationkey::VARCHAR, '|' ORDER BY n_nationkey::VARCHAR) AS c FROM nation)
SELECT 'regions' AS name, i AS identity, c AS canonical FROM a UNION ALL SELECT 'regions renumbered', i, c FROM a UNION ALL SELECT 'nations', true, c FROM b
""")
def partition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether clusterings merge anything, and a text that is equal for equal ones, however clusters are numbered."""
    leaves = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("leaf"))
    cases = {"regions": leaves, "regions renumbered": leaves.withColumn("cluster", 90 - F.col("cluster")), "nations": leaves.withColumn("cluster", F.col("leaf"))}
    parts = [hierarchy.is_identity(p).crossJoin(hierarchy.canonical(p)).select(F.lit(n).alias("name"), "identity", "canonical") for n, p in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'g' || n_regionkey AS theme, 's' || (n_nationkey // 2) AS subtheme, n_name AS code_key FROM nation")
def themes_and_subthemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes and subthemes from the last two of three passes of clustering."""
    nation = table(spark, sf_dir, "nation")
    of = lambda n, cluster: nation.select(F.lit(n).alias("pass"), cluster.alias("cluster"), F.col("n_name").alias("code_key"))
    passes = of(1, F.col("n_name")).unionByName(of(2, F.concat(F.lit("s"), F.floor(F.col("n_nationkey") / 2).cast("string")))).unionByName(of(3, F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))))
    return hierarchy.themes_and_subthemes(passes)


@query("SELECT 2 AS n_passes, cluster, codes FROM (SELECT (n_regionkey % 2)::BIGINT AS cluster, list(n_name ORDER BY n_name) AS codes FROM nation GROUP BY 1)")
def multipass_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves merged by region, then by the region's parity, until a proposal changes nothing."""
    leaves = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("leaf"), F.array("n_name").alias("codes"))
    by = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("cluster"), F.col("n_nationkey").cast("long").alias("leaf"))

    def propose(now: DataFrame, n: int) -> DataFrame:
        return by if n == 1 else now.select((F.col("leaf") % 2 if n == 2 else F.col("leaf")).alias("cluster"), "leaf")

    out, passes = hierarchy.multipass(leaves, propose)
    return out.select(F.lit(passes).alias("n_passes"), F.col("leaf").alias("cluster"), "codes")


@query("""
WITH c AS (SELECT n_name AS name, n_nationkey AS id FROM nation WHERE n_nationkey < 20), f AS (SELECT s_nationkey AS id, count(*) AS k FROM supplier GROUP BY 1)
SELECT 'bracket' AS policy, name AS theme, 'framework' AS kind, k AS frequency FROM c JOIN f USING (id) UNION ALL SELECT 'bracket', 'Anomalies', 'anomaly_bracket', sum(k)::BIGINT FROM f WHERE id >= 20 HAVING sum(k) > 0
UNION ALL SELECT 'extend', name, 'framework', k FROM c JOIN f USING (id) UNION ALL SELECT 'extend', 'n' || id, 'emergent', k FROM f WHERE id >= 20
""")
def framework_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs that were coded, and what lies outside them by two policies."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    constructs = nation.where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    codes = supplier.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("code_key")).agg(F.count("*").alias("frequency"))
    outside = supplier.where("s_nationkey >= 20").select(F.concat(F.lit("n"), "s_nationkey").alias("slug"))
    parts = [hierarchy.framework_themes(codes, constructs, outside, p).select(F.lit(p).alias("policy"), "theme", "kind", "frequency") for p in ("bracket", "extend")]
    return parts[0].unionByName(parts[1])


@query("SELECT s_suppkey, CASE WHEN i = 1 THEN s ELSE s || ' (' || i || ')' END AS name FROM (SELECT s_suppkey, 'Supplier ' || s_nationkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)")
def unique_theme_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Supplier "), "s_nationkey").alias("name"))
    return hierarchy.unique_names(rows, "name", "s_suppkey")


@query("SELECT o_orderkey, list_filter([o_orderpriority, o_orderstatus], lambda x: x <> '') AS codes FROM orders")
def legacy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes stored as joined text read as lists."""
    cell = F.concat(F.lit(" ;"), F.col("o_orderpriority"), F.lit(";; "), F.col("o_orderstatus"), F.lit(" ;"))
    return table(spark, sf_dir, "orders").select("o_orderkey", hierarchy.legacy_codes(cell).alias("codes"))


@query("SELECT p_brand AS code_key, ((row_number() OVER (ORDER BY p_brand) - 1) // 7)::BIGINT AS chunk, p_brand || '|3|9' AS segment FROM (SELECT DISTINCT p_brand FROM part)")
def chunked_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook in chunks of seven, and keys of segments."""
    book = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code_key")).distinct()
    return hierarchy.chunked(book, "code_key", 7).select("code_key", F.col("chunk").cast("long").alias("chunk"), hierarchy.segment_key(F.col("code_key"), F.lit(3), F.lit(9)).alias("segment"))


# --- reports, lifecycle, settings -----------------------------------------------------------


@query("""
WITH f AS (SELECT n_regionkey, max(CASE WHEN n_nationkey % 7 = 0 THEN 2 WHEN n_nationkey % 7 = 1 THEN 1 ELSE 0 END) AS l, list(DISTINCT n_name ORDER BY n_name) AS t FROM nation WHERE n_regionkey <> 4 GROUP BY 1)
SELECT r_name AS facet, CASE coalesce(l, 0) WHEN 2 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS level, coalesce(t, []) AS themes FROM region LEFT JOIN f ON n_regionkey = r_regionkey
""")
def coverage_of_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a research question's facets are covered; odd words count as none."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey") % 7
    found = nation.where("n_regionkey <> 4").join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("r_name").alias("facet"), F.when(k == 0, "full").when(k == 1, "partial").otherwise("splendid").alias("level"), F.col("n_name").alias("theme"))
    return lifecycle.coverage_of_facets(region.select(F.col("r_name").alias("facet")), found)


@query("SELECT p_brand AS code_key FROM part GROUP BY 1 ORDER BY min(p_partkey) DESC LIMIT 20")
def last_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty codes born last, which a prompt shows."""
    book = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code_key")).agg(F.min("p_partkey").alias("birth_ord"))
    return lifecycle.last_code_names(book).select("code_key")


@query("SELECT o_orderstatus AS theme, " + ", ".join(f"count(DISTINCT o_custkey) FILTER (o_orderpriority = '{c}') AS \"{c}\"" for c in ("1-URGENT", "2-HIGH", "6-NONE")) + " FROM orders GROUP BY 1")
def question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions put to each theme by category, each quote once."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("theme"), F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("quote_id"))
    return lifecycle.question_counts(asked, ["1-URGENT", "2-HIGH", "6-NONE"])


@query("SELECT DISTINCT o_orderstatus AS theme, c.category FROM orders, (SELECT unnest(['1-URGENT', '5-LOW', '6-NONE', '7-NEVER']) AS category) c WHERE c.category = '6-NONE' OR (c.category = '7-NEVER' AND o_orderstatus <> 'F') OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = c.category OR c.category = '7-NEVER')")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of theme and category neither asked nor skipped."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("theme"), F.col("o_orderpriority").alias("category"))
    listed = spark.createDataFrame([(c,) for c in ("1-URGENT", "5-LOW", "6-NONE", "7-NEVER")], "category string")
    return lifecycle.open_questions(orders, listed, orders, spark.createDataFrame([("F", "7-NEVER")], "theme string, category string"))


@query("SELECT user_id AS run_id, CASE WHEN max((event_type = 'error')::INT) = 1 THEN 'finalized' ELSE arg_max(CASE event_type WHEN 'error' THEN 'finalized' ELSE event_type END, (ts, event_type)) END AS state FROM events GROUP BY 1")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each run from its log; a final state stays."""
    state = F.when(F.col("event_type") == "error", "finalized").otherwise(F.col("event_type"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", state.alias("state"), F.lit("M1").alias("mode"))
    return lifecycle.states(log).select("run_id", "state")


@query("SELECT n_name AS run_id, 'framework_applied' AS mode, NULL AS parent_run_id, 'open' AS state FROM nation UNION ALL SELECT 'run_x_M1', 'reflexive_scaffold', 'NATION_3', 'open'")
def run_forked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run taken up under another mode is a copy with its lineage."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("run_id"), F.lit("framework_applied").alias("mode"), F.lit("open").alias("state"))
    return lifecycle.forked(rows, "NATION_3", lifecycle.run_id("x", "reflexive_scaffold"), "reflexive_scaffold")


@query("SELECT unnest(['match', 'fork_required', 'blocked']) AS verdict, unnest([0, 1, 2]) AS i")
def mode_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("M1", "M1", True), ("M1", "M2", True), ("M1", "M2", False)]
    return spark.createDataFrame([(i, lifecycle.mismatch(*c)) for i, c in enumerate(cases)], "i int, verdict string")


@query("SELECT n_nationkey AS memo FROM nation WHERE n_nationkey % 4 = 2 AND n_regionkey = 1")
def memo_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos of one type that are linked to a theme."""
    kind = F.element_at(F.array(*map(F.lit, lifecycle.MEMO_TYPES)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("memo"), kind.alias("type"), F.lit("A").alias("author"), F.array(F.concat(F.lit("t"), "n_regionkey"), F.lit("all")).alias("themes"))
    return lifecycle.memos(rows, lifecycle.MEMO_TYPES[2], "A", "t1").select("memo")


@query("SELECT unnest(['framework', 'emergent', 'anomaly_bracket', 'other']) AS kind, unnest([0, 1, 2, 3])::INT AS place")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order a report lists kinds of themes."""
    rows = spark.createDataFrame([(k,) for k in ("framework", "emergent", "anomaly_bracket", "other")], "kind string")
    return rows.select("kind", themes.display_order(F.col("kind")).alias("place"))


_GROUPS = {"n_unique": "metadata", "entries_by_month": "metadata", "hour_of_day_distribution": "metadata", "mean": "substantive", "gini": "substantive", "": ""}


@query(f"SELECT unnest({list(_GROUPS)}) AS metric, unnest({list(_GROUPS.values())}) AS kind")
def metric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m, lifecycle.metric_group(m)) for m in _GROUPS], "metric string, kind string")


@query("SELECT p_brand, 'skewness' AS metric, count(*) AS n_observed, count(*) < 30 AS small_n FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'mean', count(*), false FROM part GROUP BY 1")
def small_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that need many values are flagged where there are few."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n_observed")).select("p_brand", F.explode(F.array(F.lit("skewness"), F.lit("mean"))).alias("metric"), "n_observed")
    return lifecycle.small_sample(rows, [n for n, m in metrics.CATALOGUE.items() if m.needs_many])


#: Reasons that reach every class, in its order.
_REASONS = ("AI response parse failure", "gif only", "reposted", "link only", "reply to a post", "just asking", "too short", "off-topic", "nothing of the kind", "")
_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(r), '{pattern}') THEN '{label}'" for label, pattern in ((n, p.replace("'", "''")) for n, p in coverage.SKIP_CLASSES)) + f" ELSE '{coverage.OTHER}' END"


@query(f"WITH e AS (SELECT CASE WHEN r = '' THEN '(unspecified)' ELSE r END AS r FROM (SELECT {list(_REASONS)}[event_id % {len(_REASONS)} + 1] AS r FROM events)), c AS (SELECT {_CASE} AS label, count(*) AS n FROM e GROUP BY 1) SELECT label, n, (row_number() OVER (ORDER BY label = '{coverage.OTHER}', n DESC, label))::INT AS place FROM c")
def skip_classes_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes of skip reasons in a report's order, the unnamed last."""
    reason = F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("event_id") % len(_REASONS) + 1).cast("int"))
    classes = coverage.reported_order(coverage.skip_classes(table(spark, sf_dir, "events").select(reason.alias("reason")))).select("label", "n").collect()  # a row a class
    return spark.createDataFrame([(r["label"], r["n"], i) for i, r in enumerate(classes, 1)], "label string, n long, place int")


@query("""
WITH c AS (SELECT l_returnflag AS study, l_partkey % 40 AS code, l_suppkey AS source, l_quantity AS n FROM lineitem), k AS (SELECT study, code, count(*) AS k FROM c GROUP BY ALL), s AS (SELECT study, source, 100 * sum(n) / 5000 AS pct FROM c GROUP BY ALL)
SELECT study, (SELECT count(*) FROM c x WHERE x.study = k.study) AS n_segments, count(*) AS n_codes, round(quantile_cont(k, 0.25), 6) AS frequency_p25, round(quantile_cont(k, 0.9), 6) AS frequency_p90,
       (SELECT round(avg(n), 6) FROM c x WHERE x.study = k.study) AS mean_length, (SELECT median(n) FROM c x WHERE x.study = k.study) AS median_length, (SELECT round(median(pct), 6) FROM s WHERE s.study = k.study) AS median_coverage, (SELECT round(max(pct), 6) FROM s WHERE s.study = k.study) AS max_coverage FROM k GROUP BY study
""")
def coding_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies, lengths and coverage of earlier studies' codings."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("study"), (F.col("l_partkey") % 40).alias("code"), F.col("l_suppkey").alias("source"), F.col("l_quantity").alias("n_chars"), F.lit(5000).alias("source_chars"))
    out = codebooks.coding_benchmarks(rows).select("study", "n_segments", "n_codes", "frequency_p25", "frequency_p90", "mean_length", "median_length", "median_coverage", "max_coverage")
    return _rounded(out)


@query("SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal']) AS metric, 'all' AS asked UNION ALL SELECT 'c_acctbal', 'some'")
def metric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns to describe: all that aren't internal, or those asked for that there are."""
    rows = table(spark, sf_dir, "customer").withColumns({"sentiment_score": F.lit(0.5), "theme_membership_a": F.lit(1)})
    found = [(m, "all") for m in ingest.metric_columns(rows)] + [(m, "some") for m in ingest.metric_columns(rows, ["c_acctbal", "c_name", "none"])]
    return spark.createDataFrame(found, "metric string, asked string")


@query("SELECT unnest(['analysis.mode', 'analysis.min_theme_entries', 'comparison.threshold', 'data.seed', 'preprocessing.min_text_length']) AS key, unnest(['framework_applied', '7', '0.75', '42', '10']) AS value")
def settings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings over defaults, with dotted overrides; null leaves don't count."""
    found = config.loaded('{"analysis": {"mode": "framework_applied", "min_theme_entries": 3}, "data": {"seed": null}}', {"analysis.min_theme_entries": 7})
    keys = ("analysis.mode", "analysis.min_theme_entries", "comparison.threshold", "data.seed", "preprocessing.min_text_length")
    return spark.createDataFrame([(k, str(found[k.split(".")[0]][k.split(".")[1]])) for k in keys], "key string, value string")


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, [n_name, 'x'] AS indicators FROM nation")
def framework_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framework's constructs, its fields checked."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows, a framework's
    spec = {"name": "nations", "stance": "realist", "anomaly_policy": "bracket", "constructs": [{"id": f"n{r['n_nationkey']}", "name": r["n_name"], "indicators": [r["n_name"], "x"]} for r in rows]}
    return config.framework(spark, spec).select("id", "name", "indicators")
