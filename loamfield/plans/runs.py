"""Queries on runs compared and on hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import jaro_similarity
from ..operators import comparison, hierarchy
from ..sources import ingest
from .registry import query, table


def _sample(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """The documents that one of two overlapping runs looked at, some of them changed since."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 10 != part)
    return docs.select(F.col("doc_id").alias("std_id"), F.when(F.col("doc_id") % 7 == part, F.upper("text")).otherwise(F.col("text")).alias("std_text"))


@query("""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN upper(text) ELSE text END AS t FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN upper(text) ELSE text END AS t FROM documents WHERE doc_id % 10 <> 2),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, a.t AS s, b.t AS u FROM a FULL JOIN b ON a.doc_id = b.doc_id),
c AS (SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_shared, count(*) FILTER (y IS NULL) AS n_new, count(*) FILTER (x IS NULL) AS n_dropped, count(*) FILTER (s <> u) AS n_text_changes FROM j)
SELECT *, round(n_shared / (n_shared + n_new + n_dropped), 3) AS jaccard, round(100 * n_shared / (n_shared + n_new), 1) AS pct_shared, 'overlapping samples' AS interpretation FROM c
""")
def sample_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.samples(_sample(spark, sf_dir, 1), _sample(spark, sf_dir, 2))


_RUNS = """
r AS (SELECT CASE WHEN day(ts) <= 15 THEN 'run_1' ELSE 'run_2' END AS run_id, user_id AS std_id, avg(value) AS v, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS e FROM events GROUP BY ALL)
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in two halves of the time as two runs: a score, and labels."""
    run = F.when(F.dayofmonth("ts") <= 15, "run_1").otherwise("run_2")
    labels = F.array_join(F.array_sort(F.collect_set("event_type")), "; ")
    return table(spark, sf_dir, "events").groupBy(run.alias("run_id"), F.col("user_id").alias("std_id")).agg(F.avg("value").alias("sentiment_score"), labels.alias("all_emotions")).withColumn("emerged_themes", F.col("all_emotions"))


@query(f"""
WITH {_RUNS} SELECT a.std_id, round(a.v - b.v, 6) AS shift, len(list_intersect(string_split(a.e, '; '), string_split(b.e, '; '))) / len(list_distinct(list_concat(string_split(a.e, '; '), string_split(b.e, '; ')))) < 0.5 AS reclassified
FROM r a JOIN r b USING (std_id) WHERE a.run_id = 'run_2' AND b.run_id = 'run_1'
""")
def sentiment_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    return comparison.sentiment_drift(rows.where("run_id = 'run_2'"), rows.where("run_id = 'run_1'")).withColumn("shift", F.round("shift", 6))


@query(f"WITH {_RUNS} SELECT b.e AS theme_prev, a.e AS theme_curr, count(*) AS n_entries FROM r a JOIN r b USING (std_id) WHERE a.run_id = 'run_2' AND b.run_id = 'run_1' GROUP BY ALL")
def entry_migration_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    return comparison.migration(rows.where("run_id = 'run_2'"), rows.where("run_id = 'run_1'"))


@query(f"WITH {_RUNS}, j AS (SELECT a.e = b.e AS same FROM r a JOIN r b USING (std_id) WHERE a.run_id = 'run_2' AND b.run_id = 'run_1') SELECT count(*) AS n_shared, count(*) FILTER (same) AS n_stable, count(*) FILTER (NOT same) AS n_migrated, round(count(*) FILTER (same) / count(*), 3) AS stability_rate FROM j")
def migration_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    return comparison.migration_stability(rows.where("run_id = 'run_2'"), rows.where("run_id = 'run_1'"))


@query(f"WITH {_RUNS} SELECT run_id, count(*) AS n_entries, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, round(100 * count(*) FILTER (v < 0) / count(v), 6) AS pct_negative, round(100 * count(*) FILTER (v > 0) / count(v), 6) AS pct_positive FROM r GROUP BY 1")
def run_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = comparison.sentiment_by_run(_runs(spark, sf_dir))
    return out.select("run_id", "n_entries", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "pct_negative", "pct_positive")))


@query(f"WITH {_RUNS}, e AS (SELECT run_id, unnest(string_split(e, '; ')) AS l FROM r), c AS (SELECT run_id, l, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, l) AS i FROM e GROUP BY run_id, l) SELECT run_id, string_agg(l, '; ' ORDER BY i) AS top_emotions FROM c WHERE i <= 3 GROUP BY 1")
def top_emotions_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.top_emotions(_runs(spark, sf_dir))


@query("SELECT a.n_name AS a, b.r_name AS b, round(jaro_similarity(a.n_name, b.r_name), 6) AS score FROM nation a, region b")
def code_text_jaro_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a")).crossJoin(table(spark, sf_dir, "region").select(F.col("r_name").alias("b")))  # 25 by 5
    return pairs.withColumn("score", F.round(jaro_similarity("a", "b"), 6))


def _brands(spark: SparkSession, sf_dir: str, cut: int) -> DataFrame:
    name = F.when(F.col("p_size") % 5 == cut, F.concat("p_brand", F.lit(" x"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").where(F.col("p_size") % 7 != cut).select(name.alias("code_text")).distinct()


_GREEDY = """
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, j, i) AS k FROM p WHERE score >= {least}),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS l, []::BIGINT[] AS r, false AS ok UNION ALL
      SELECT o.k, CASE WHEN list_contains(l, i) OR list_contains(r, j) THEN l ELSE list_append(l, i) END, CASE WHEN list_contains(l, i) OR list_contains(r, j) THEN r ELSE list_append(r, j) END, NOT (list_contains(l, i) OR list_contains(r, j)) FROM g JOIN o ON o.k = g.k + 1),
m AS (SELECT o.* FROM o JOIN g USING (k) WHERE ok)
"""
_BOOK = "(SELECT t, row_number() OVER (ORDER BY t) - 1 AS {k} FROM (SELECT DISTINCT CASE WHEN p_size % 5 = {c} THEN p_brand || ' x' ELSE p_brand END AS t FROM part WHERE p_size % 7 <> {c}))"


@query(f"""
WITH RECURSIVE x AS {_BOOK.format(k='i', c=1)}, y AS {_BOOK.format(k='j', c=2)}, p AS (SELECT i, j, x.t AS a, y.t AS b, jaro_similarity(lower(x.t), lower(y.t)) AS score FROM x, y), {_GREEDY.format(least=0.75 * 0.8)}
SELECT b AS code_prev, a AS code_curr, round(score, 3) AS similarity, CASE WHEN score >= 0.95 THEN 'stable' ELSE 'renamed' END AS status FROM m
UNION ALL SELECT NULL, t, NULL, 'new' FROM x WHERE t NOT IN (SELECT a FROM m) UNION ALL SELECT t, NULL, NULL, 'dropped' FROM y WHERE t NOT IN (SELECT b FROM m)
""")
def code_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two runs matched one to one: stable, renamed, new and dropped."""
    return comparison.code_changes(_brands(spark, sf_dir, 1), _brands(spark, sf_dir, 2))


@query(f"""
WITH RECURSIVE n AS (SELECT r_name, lower(n_name) AS c, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey), y AS (SELECT r_name AS b, list(c) AS cb, row_number() OVER (ORDER BY r_name) - 1 AS j FROM n GROUP BY r_name),
x AS (SELECT lower(r_name) AS a, list(c) AS ca, row_number() OVER (ORDER BY lower(r_name)) - 1 AS i FROM n WHERE k % 5 <> 0 GROUP BY r_name),
s AS (SELECT i, j, a, b, jaro_similarity(a, lower(b)) AS name_sim, len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))) AS code_jaccard FROM x, y),
p AS (SELECT *, greatest(code_jaccard, 0.3 * name_sim + 0.7 * code_jaccard) AS score FROM s), {_GREEDY.format(least=0.75)}
SELECT a AS theme_prev, b AS theme_curr, round(name_sim, 3) AS name_sim, round(code_jaccard, 3) AS code_jaccard, 'persisted' AS status FROM m
UNION ALL SELECT NULL, b, NULL, NULL, 'new' FROM y WHERE b NOT IN (SELECT b FROM m) UNION ALL SELECT a, NULL, NULL, NULL, 'disappeared' FROM x WHERE a NOT IN (SELECT a FROM m)
""")
def theme_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    now = rows.groupBy(F.col("r_name").alias("name")).agg(F.collect_set("n_name").alias("codes"))
    then = rows.where("n_nationkey % 5 <> 0").groupBy(F.lower("r_name").alias("name")).agg(F.collect_set("n_name").alias("codes"))
    return comparison.theme_changes(now, then)


@query("SELECT lower(trim(o_orderpriority)) AS code, count(DISTINCT year(o_orderdate)) AS n_runs, min(year(o_orderdate)::VARCHAR) AS first_run, max(year(o_orderdate)::VARCHAR) AS last_run FROM orders GROUP BY 1")
def codes_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.codes_across_runs(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code_text"), F.year("o_orderdate").cast("string").alias("run_id")))


@query("""
WITH y AS (SELECT year(l_shipdate) AS run_id, corr(l_quantity, l_extendedprice) AS r1, corr(l_discount, l_tax) AS r2 FROM lineitem GROUP BY 1),
l AS (SELECT run_id, 'l_extendedprice' AS a, 'l_quantity' AS b, r1 AS r FROM y UNION ALL SELECT run_id, 'l_discount', 'l_tax', r2 FROM y), n AS (SELECT count(DISTINCT run_id) AS n FROM l)
SELECT replace(a, '_', ' ') AS var1, replace(b, '_', ' ') AS var2, count(*) AS n_runs, round(avg(r), 3) AS mean_r, CASE WHEN count(*) = 1 THEN 'run_specific' WHEN count(*) = any_value(n) THEN 'persistent' ELSE 'intermittent' END AS status FROM l, n WHERE abs(r) > 0.1 GROUP BY ALL
""")
def correlation_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("run_id")).agg(F.corr("l_quantity", "l_extendedprice").alias("a"), F.corr("l_discount", "l_tax").alias("b"))
    one = lambda x, y, r: F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"), F.col(r).alias("r"))
    found = rows.select("run_id", F.explode(F.array(one("l_quantity", "l_extendedprice", "a"), one("l_tax", "l_discount", "b"))).alias("v")).select("run_id", "v.*")
    return comparison.correlation_stability(found.withColumn("significant", F.abs("r") > 0.1))


# --- hierarchies ----------------------------------------------------------------------------

_NODES = "nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    part = lambda df, k, key, parent, name: df.select(F.concat(F.lit(k), key).alias("node_id"), parent.alias("parent_id"), F.col(name).alias("name"))
    nodes = part(region, "r", "r_regionkey", F.lit(None).cast("string"), "r_name").unionByName(part(nation, "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name")).unionByName(part(supplier, "s", "s_suppkey", F.concat(F.lit("n"), "s_nationkey"), "s_name"))
    return hierarchy.paths(nodes)


@query(f"WITH RECURSIVE {_NODES}, t AS (SELECT id, id AS root, 1 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1 FROM nodes n JOIN t ON n.parent = t.id) SELECT id AS node, root, depth::INT AS depth FROM t")
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("node", "root", "depth")


@query(f"""
WITH RECURSIVE {_NODES}, t AS (SELECT id, [id] AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, list_append(t.path, n.id) FROM nodes n JOIN t ON n.parent = t.id),
u AS (SELECT unnest(path) AS node, l_orderkey FROM lineitem JOIN t ON t.id = 's' || l_suppkey) SELECT node, count(*) AS n_refs, count(DISTINCT l_orderkey) AS n_sources FROM u GROUP BY 1
""")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a node and all below it, and their distinct sources."""
    refs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("node"), F.col("l_orderkey").alias("source"))
    return hierarchy.rolled_up(refs, _tree(spark, sf_dir))


@query("SELECT 'r' || r_regionkey AS root, count(DISTINCT n_nationkey) AS n_subthemes, count(DISTINCT n_nationkey) + count(DISTINCT s_suppkey) AS n_subthemes_total, count(DISTINCT s_suppkey) AS n_codes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def subtheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_suppkey").alias("code_key"))
    return hierarchy.node_counts(_tree(spark, sf_dir), codes)


@query("SELECT n_regionkey::BIGINT AS cluster, list(n_nationkey::BIGINT ORDER BY n_nationkey) AS leaves, list(n_name ORDER BY n_name) AS codes FROM nation GROUP BY 1")
def partition_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as leaves merged by region; a proposal's gaps and overlaps are mended first."""
    nation = table(spark, sf_dir, "nation")
    leaves = nation.select(F.col("n_nationkey").cast("long").alias("leaf"), F.array("n_name").alias("codes"))
    proposal = nation.select(F.col("n_regionkey").cast("long").alias("cluster"), F.col("n_nationkey").cast("long").alias("leaf"))
    wrong = proposal.where("leaf = 3").select((F.col("cluster") + 90).alias("cluster"), "leaf").unionByName(spark.range(1).select(F.lit(7).cast("long").alias("cluster"), F.lit(999).cast("long").alias("leaf")))
    return hierarchy.applied_partition(leaves, hierarchy.normalised_partition(proposal.unionByName(wrong), leaves))


@query("""
WITH RECURSIVE n AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent FROM conversations WHERE text NOT IN ('[deleted]', '[removed]')),
t AS (SELECT id, id AS root, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT id AS node, root, depth::INT AS depth FROM t
""")
def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string"))).alias("parent"), "text")
    return ingest.flattened_threads(rows, "id", "parent", "text").select("node", "root", "depth")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def backfill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that still lack what belongs to them."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return ingest.backfill(customer.select(F.col("c_custkey")), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
