"""What changed between runs: samples, codes, themes, sentiment, migration and correlations.

A run is a group of rows with a run_id; sections are frames.  Codes and themes of a run are a
few hundred rows, and their one-to-one matching is a loop on the driver over scored pairs,
whose number is checked; everything on entries stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import quantiles, same
from ..functions.similarity import jaro_similarity, label_set, set_jaccard, split_labels

# Threshold of a match, floor of codes as a share of it, stable from, weights of a theme's score.
THRESHOLD, FLOOR, STABLE, NAME_WEIGHT = 0.75, 0.8, 0.95, 0.3
SCHEMA_MAJOR = "1"
#: Scored pairs that a matching gathers, at most.
MOST_PAIRS = 1_000_000


def compatible_schema(version: Column, major: str = SCHEMA_MAJOR) -> Column:
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)) == major, F.lit(False))


def sample_band(jaccard: Column) -> Column:
    return F.when(jaccard >= 1, "identical sample").when(jaccard >= 0.9, "mostly same sample").when(jaccard >= 0.5, "overlapping samples").otherwise("largely different samples")


def samples(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: ids shared, new and dropped, Jaccard (3 decimals), share, changed texts, and a band."""
    a = current.select("std_id", F.col("std_text").alias("_a"), F.lit(True).alias("_in_a"))
    b = previous.select("std_id", F.col("std_text").alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, "std_id", "full")
    ia, ib = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()
    out = both.agg(
        F.count_if(ia & ib).alias("n_shared"),
        F.count_if(ia & ~ib).alias("n_new"),
        F.count_if(ib & ~ia).alias("n_dropped"),
        F.count_if(ia & ib & (F.col("_a") != F.col("_b"))).alias("n_text_changes"),
    )
    n, union = F.col("n_shared"), F.col("n_shared") + F.col("n_new") + F.col("n_dropped")
    jaccard = F.when(union > 0, F.round(n / union, 3)).otherwise(0.0)
    share = F.when(n + F.col("n_new") > 0, F.round(100 * n / (n + F.col("n_new")), 1)).otherwise(0.0)
    return out.withColumns({"jaccard": jaccard, "pct_shared": share, "interpretation": sample_band(jaccard)})


def sentiment_by_run(rows: DataFrame) -> DataFrame:
    """One row a run: moments of the score and shares below and above zero among scored rows."""
    s = F.col("sentiment_score")
    n = F.count(s)
    middle = quantiles(rows, "sentiment_score", [0.5], ["run_id"]).select("run_id", F.col("_q")[0].alias("median"))
    out = rows.groupBy("run_id").agg(
        F.count("*").alias("n_entries"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("sd"),
        F.when(n > 0, 100 * F.count_if(s < 0) / n).alias("pct_negative"),
        F.when(n > 0, 100 * F.count_if(s > 0) / n).alias("pct_positive"),
    )
    return same(out, middle, ["run_id"])


def top_emotions(rows: DataFrame, k: int = 3) -> DataFrame:
    """(run_id, top_emotions): the ``k`` most frequent labels of each run, ties by name."""
    counts = rows.select("run_id", F.explode(split_labels(F.col("all_emotions"))).alias("label")).groupBy("run_id", "label").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("n"), "label"))
    best = counts.withColumn("_i", place).where(F.col("_i") <= k)
    return best.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "label"))), lambda x: x["label"]), "; ").alias("top_emotions"))


def sentiment_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(std_id, shift, reclassified) of the entries in both runs: reclassified when under half of the emotions agree."""
    a = current.select("std_id", F.col("sentiment_score").alias("_s"), F.col("all_emotions").alias("_e"))
    b = previous.select("std_id", F.col("sentiment_score").alias("_t"), F.col("all_emotions").alias("_f"))
    changed = F.when(F.col("_e").isNotNull() & F.col("_f").isNotNull(), set_jaccard(split_labels(F.col("_e")), split_labels(F.col("_f")), 1.0) < 0.5)
    return a.join(b, "std_id").select("std_id", (F.col("_s") - F.col("_t")).alias("shift"), changed.alias("reclassified"))


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(F.count("*").alias("n_shared"), F.avg("shift").alias("mean_shift"), (100 * F.count_if("reclassified") / F.when(F.count("reclassified") > 0, F.count("reclassified"))).alias("reclassification_rate"))


def migration(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(theme_prev, theme_curr, n_entries) of the theme cells of entries in both runs."""
    return current.select("std_id", F.col("emerged_themes").alias("theme_curr")).join(previous.select("std_id", F.col("emerged_themes").alias("theme_prev")), "std_id").groupBy("theme_prev", "theme_curr").agg(F.count("*").alias("n_entries"))


def migration_stability(current: DataFrame, previous: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """One row: entries whose sets of themes stayed, after themes are given their former names.

    ``renamed`` has (theme_curr, theme_prev) of matched themes, a row a theme.
    """
    cells = current.select("std_id", F.col("emerged_themes").alias("_c")).join(previous.select("std_id", F.col("emerged_themes").alias("_p")), "std_id")
    now = F.array_sort(F.array_distinct(split_labels(F.col("_c"))))
    if renamed is not None:
        names = renamed.agg(F.map_from_entries(F.collect_list(F.struct("theme_curr", "theme_prev"))).alias("_names"))
        cells = cells.crossJoin(F.broadcast(names))  # one row
        now = F.array_sort(F.array_distinct(F.transform(now, lambda t: F.coalesce(F.element_at(F.col("_names"), t), t))))
    same = now == F.array_sort(F.array_distinct(split_labels(F.col("_p"))))
    out = cells.agg(F.count("*").alias("n_shared"), F.count_if(same).alias("n_stable"), F.count_if(~same).alias("n_migrated"))
    return out.withColumn("stability_rate", F.when(F.col("n_shared") > 0, F.round(F.col("n_stable") / F.col("n_shared"), 3)))


def scored_code_pairs(current: DataFrame, previous: DataFrame, code: str = "code_text") -> DataFrame:
    """(i, j, a, b, score): Jaro similarity of every pair of two runs' codes (a few hundred rows each)."""
    a = _numbered(current.select(F.col(code).alias("a")), "i", "a")
    b = _numbered(previous.select(F.col(code).alias("b")), "j", "b")
    return a.crossJoin(b).withColumn("score", jaro_similarity(F.lower(F.trim("a")), F.lower(F.trim("b"))))


def _numbered(df: DataFrame, to: str, by: str) -> DataFrame:
    """Rows of a small table numbered from 0 in their order."""
    return df.withColumn(to, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(by)) - 1)


def scored_theme_pairs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(i, j, a, b, name_sim, code_jaccard, score) of two runs' themes (name, codes ARRAY)."""
    a = _numbered(previous.select(F.col("name").alias("a"), label_set(F.col("codes")).alias("_a")), "i", "a")
    b = _numbered(current.select(F.col("name").alias("b"), label_set(F.col("codes")).alias("_b")), "j", "b")
    pairs = a.crossJoin(b).withColumns({"name_sim": jaro_similarity(F.lower("a"), F.lower("b")), "code_jaccard": set_jaccard(F.col("_a"), F.col("_b"), 1.0)})
    return pairs.withColumn("score", F.greatest("code_jaccard", NAME_WEIGHT * F.col("name_sim") + (1 - NAME_WEIGHT) * F.col("code_jaccard"))).drop("_a", "_b")


def matched(pairs: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (i, j, score, ...) that a greedy one-to-one matching keeps, best first.

    Of equal scores the one with the smaller j goes first, then the smaller i.  Pairs under
    ``least`` are never gathered; more than MOST_PAIRS are an error.
    """
    rows = pairs.where(F.col("score") >= least).select("i", "j", "score").limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs reach {least}")
    left: set[int] = set()
    right: set[int] = set()
    kept = []
    for r in sorted(rows, key=lambda r: (-round(r["score"], 12), r["j"], r["i"])):  # sums in another order are no other score
        if r["i"] not in left and r["j"] not in right:
            left.add(r["i"])
            right.add(r["j"])
            kept.append((r["i"], r["j"]))
    spark = pairs.sparkSession
    found = pairs.join(F.broadcast(spark.createDataFrame(kept, "i int, j int")), ["i", "j"])  # a row a code
    return spark.createDataFrame(found.collect(), found.schema)  # held, so that what follows scores no pair again


def code_changes(current: DataFrame, previous: DataFrame, code: str = "code_text", threshold: float = THRESHOLD) -> DataFrame:
    """(code_prev, code_curr, similarity, status): stable, renamed, new or dropped codes."""
    pairs = matched(scored_code_pairs(current, previous, code), threshold * FLOOR).select(F.col("b").alias("code_prev"), F.col("a").alias("code_curr"), F.round("score", 3).alias("similarity"), F.when(F.col("score") >= STABLE, "stable").otherwise("renamed").alias("status"))
    none = F.lit(None)
    new = current.join(pairs, current[code] == pairs["code_curr"], "left_anti").select(none.cast("string").alias("code_prev"), F.col(code).alias("code_curr"), none.cast("double").alias("similarity"), F.lit("new").alias("status"))
    dropped = previous.join(pairs, previous[code] == pairs["code_prev"], "left_anti").select(F.col(code).alias("code_prev"), none.cast("string").alias("code_curr"), none.cast("double").alias("similarity"), F.lit("dropped").alias("status"))
    return pairs.unionByName(new).unionByName(dropped)


def code_stability(changes: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("status").isin("stable", "renamed"))
    total = F.count("*")
    return changes.agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("stable", "renamed", "new", "dropped")),
        F.when(total > 0, F.round(kept / total, 3)).otherwise(1.0).alias("jaccard"),
        F.when(total > 0, F.round((total - kept) / total, 3)).otherwise(0.0).alias("churn_rate"),
    )


def theme_changes(current: DataFrame, previous: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(theme_prev, theme_curr, name_sim, code_jaccard, status): persisted, new or disappeared themes."""
    pairs = matched(scored_theme_pairs(previous, current), threshold).select(F.col("a").alias("theme_prev"), F.col("b").alias("theme_curr"), F.round("name_sim", 3).alias("name_sim"), F.round("code_jaccard", 3).alias("code_jaccard"), F.lit("persisted").alias("status"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    new = current.join(pairs, current["name"] == pairs["theme_curr"], "left_anti").select(none.alias("theme_prev"), F.col("name").alias("theme_curr"), number.alias("name_sim"), number.alias("code_jaccard"), F.lit("new").alias("status"))
    gone = previous.join(pairs, previous["name"] == pairs["theme_prev"], "left_anti").select(F.col("name").alias("theme_prev"), none.alias("theme_curr"), number.alias("name_sim"), number.alias("code_jaccard"), F.lit("disappeared").alias("status"))
    return pairs.unionByName(new).unionByName(gone)


def codes_across_runs(codes: DataFrame) -> DataFrame:
    """(code, n_runs, first_run, last_run) of codes (code_text, run_id) in lower case."""
    return codes.groupBy(F.lower(F.trim("code_text")).alias("code")).agg(F.countDistinct("run_id").alias("n_runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


def theme_timeline(themes: DataFrame) -> DataFrame:
    """(run_idx, run_id, name, entry_count) of all runs' themes, runs numbered from 1 in order."""
    runs = _numbered(themes.select("run_id").distinct(), "run_idx", "run_id").withColumn("run_idx", F.col("run_idx") + 1)
    return themes.join(runs, "run_id").select("run_idx", "run_id", "name", "entry_count")


def normal_variable(name: Column) -> Column:
    """Names of correlated variables without the membership prefix, separators as spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, "^theme_membership_", ""), r"[._\s]+", " ")))


def correlation_stability(found: DataFrame) -> DataFrame:
    """(var1, var2, n_runs, mean_r, status) of significant pairs (run_id, var1, var2, r, significant), in any order of the two.

    A pair is persistent in all runs that have correlations (of two or more), run-specific in
    one, else intermittent.
    """
    runs = found.agg(F.countDistinct("run_id").alias("_runs"))
    pair = F.array_sort(F.array(normal_variable(F.col("var1")), normal_variable(F.col("var2"))))
    pairs = found.where("significant").groupBy(pair.alias("_p")).agg(F.count("*").alias("n_runs"), F.round(F.avg("r"), 3).alias("mean_r")).crossJoin(F.broadcast(runs))  # one row
    status = F.when(F.col("n_runs") == 1, "run_specific").when((F.col("_runs") >= 2) & (F.col("n_runs") == F.col("_runs")), "persistent").otherwise("intermittent")
    return pairs.select(F.col("_p")[0].alias("var1"), F.col("_p")[1].alias("var2"), "n_runs", "mean_r", status.alias("status"))


def current_and_previous(runs: DataFrame) -> DataFrame:
    """The last two runs (run_id, schema_version) of a compatible schema, marked current and previous."""
    usable = runs.where(compatible_schema(F.col("schema_version"))).orderBy(F.desc("run_id")).limit(2)
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("run_id")))  # two rows
    return usable.withColumn("role", F.when(place == 1, "current").otherwise("previous"))


def cross_model_pair(runs: DataFrame) -> DataFrame:
    """The newest run and the latest before it of another provider or model."""
    newest = runs.orderBy(F.desc("run_id")).limit(1).select(F.col("run_id").alias("_r"), F.col("provider").alias("_p"), F.col("model").alias("_m"))
    other = runs.crossJoin(F.broadcast(newest)).where((F.col("run_id") < F.col("_r")) & ((F.col("provider") != F.col("_p")) | (F.col("model") != F.col("_m"))))  # one row
    return newest.select(F.col("_r").alias("run_id"), F.lit("current").alias("role")).unionByName(other.orderBy(F.desc("run_id")).limit(1).select("run_id", F.lit("previous").alias("role")))


def set_sizes(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys in both, only in the first, only in the second, and in either."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, list(keys), "full")
    return both.agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_first"), F.count_if(F.col("_a").isNull()).alias("n_second"), F.count("*").alias("n_either"))
