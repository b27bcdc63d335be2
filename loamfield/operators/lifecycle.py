"""Runs as rows: started, locked when finished, forked under another mode; memos and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Short names of modes.
CODES = {"reflexive_scaffold": "M1", "codebook_collaborative": "M2", "framework_applied": "M3"}
MEMO_TYPES = ("analytic", "methodological", "reflexive", "theoretical")


def run_id(time: str, mode: str) -> str:
    return f"run_{time}_{CODES[mode]}"


def states(log: DataFrame) -> DataFrame:
    """The latest state of each run from an append-only log (run_id, ts, state, mode)."""
    return log.groupBy("run_id").agg(F.max_by(F.struct("state", "mode"), F.struct("ts", "state")).alias("s"), F.count_if(F.col("state") == "finalized").alias("n_final")).select("run_id", F.when(F.col("n_final") > 0, "finalized").otherwise(F.col("s.state")).alias("state"), "s.mode")


def mismatch(current: str, run_mode: str, finalized: bool) -> str:
    """What may be done with a run under another mode than its own."""
    if current == run_mode:
        return "match"
    return "fork_required" if finalized else "blocked"


def forked(runs: DataFrame, source: str, new_id: str, mode: str) -> DataFrame:
    """``runs`` with a copy of ``source`` under a new id and mode, its lineage kept."""
    copy = runs.where(F.col("run_id") == source).withColumns({"run_id": F.lit(new_id), "mode": F.lit(mode), "state": F.lit("open"), "parent_run_id": F.lit(source)})
    base = runs if "parent_run_id" in runs.columns else runs.withColumn("parent_run_id", F.lit(None).cast("string"))
    return base.unionByName(copy.select(*base.columns))


def memos(rows: DataFrame, kind: str | None = None, author: str | None = None, theme: str | None = None) -> DataFrame:
    if kind is not None and kind not in MEMO_TYPES:
        raise ValueError(f"a memo's type is one of {MEMO_TYPES}")
    for test in (kind and F.col("type") == kind, author and F.col("author") == author, theme and F.array_contains("themes", theme)):
        if test is not None and test is not False:
            rows = rows.where(test)
    return rows


def open_questions(themes: DataFrame, categories: DataFrame, attempts: DataFrame, skips: DataFrame) -> DataFrame:
    """Pairs of theme and category that were neither asked nor skipped: a run picked up again asks only these."""
    grid = themes.select("theme").distinct().crossJoin(F.broadcast(categories.select("category").distinct()))
    return grid.join(attempts, ["theme", "category"], "left_anti").join(skips, ["theme", "category"], "left_anti")


def counter_entries(entries: DataFrame, membership: DataFrame, theme: str, n: int = 25, seed: int = 42) -> DataFrame:
    """A sample of entries outside a theme, in their own order."""
    others = entries.join(membership.where(F.col("theme") == theme).select("std_id"), "std_id", "left_anti")
    return others.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("std_id").cast("string")).cast("binary")), "std_id").limit(n).orderBy("row_ord")


def supporting_entries(entries: DataFrame, membership: DataFrame, theme: str, chars: int = 400) -> DataFrame:
    return entries.join(membership.where(F.col("theme") == theme).select("std_id"), "std_id", "left_semi").select("std_id", F.substring("std_text", 1, chars).alias("text"))


def question_counts(asked: DataFrame, categories: list[str]) -> DataFrame:
    """A row a theme with a column a category, zero-filled; a question asked twice (quote_id) counts once."""
    once = asked.dropDuplicates(["theme", "category", "quote_id"])
    return once.groupBy("theme").pivot("category", categories).agg(F.count(F.lit(1))).na.fill(0)


def coverage_of_facets(facets: DataFrame, found: DataFrame) -> DataFrame:
    """(facet, level, themes): levels outside full, partial and none count as none."""
    level = F.when(F.col("level").isin("full", "partial", "none"), F.col("level")).otherwise("none")
    best = found.groupBy("facet").agg(F.max_by(level, F.when(level == "full", 2).when(level == "partial", 1).otherwise(0)).alias("level"), F.array_sort(F.collect_set("theme")).alias("themes"))
    return facets.join(best, "facet", "left").select("facet", F.coalesce("level", F.lit("none")).alias("level"), F.coalesce("themes", F.array().cast("array<string>")).alias("themes"))


def last_code_names(codes: DataFrame, n: int = 20) -> DataFrame:
    return codes.orderBy(F.desc("birth_ord")).limit(n)


def metric_group(primitive: str) -> str:
    """Whether a metric says something of the data's form or of its substance."""
    name = primitive.lower()
    if any(k in name for k in ("n_unique", "count", "span", "entries", "time", "hour", "day", "month")):
        return "metadata"
    return "substantive" if name else ""


def small_sample(rows: DataFrame, sensitive: list[str], floor: int = 30) -> DataFrame:
    return rows.withColumn("small_n", F.col("metric").isin(*sensitive) & (F.col("n_observed") < floor))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy(order)))
