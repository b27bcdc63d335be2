"""The three entry points: an analysis, a reflexive scaffold, and runs compared."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.text import CleaningRules
from ..operators import association, coding, comparison, coverage, lifecycle, preprocess, themes
from ..sources import config as settings
from ..sources import ingest, runs

Coder = Callable[[DataFrame], DataFrame]


def corpus(spark: SparkSession, tables: Mapping[str, DataFrame], config: Mapping[str, Any]) -> DataFrame:
    """Entries of the tables that the settings name, standardised, joined by name, cleaned, freed of copies, and sampled for a test."""
    data, pre = config["data"], config["preprocessing"]
    kind = data["source_type"]
    if data["query"]:
        tables = {"query": ingest.loaded(spark, tables, query=data["query"])}
    elif data["table"]:
        named = [data["table"]] if isinstance(data["table"], str) else list(data["table"])
        tables = {t: tables[t] for t in named if t in tables}
    else:
        name = ingest.picked_table(tables)
        tables = {name: tables[name]}
    parts = {t: ingest.standardised(df, ingest.detected_columns(df.columns, kind)) for t, df in tables.items()}
    rules = CleaningRules(kind, pre["remove_urls"], pre["remove_mentions"], pre["remove_hashtags"], pre["lowercase"])
    rows = preprocess.preprocessed(ingest.combined(parts), rules, pre["min_text_length"], pre["max_text_length"])
    return ingest.sampled_entries(rows, data["test_sample"], data["seed"]) if data["test_sample"] else rows


def analysed(spark: SparkSession, tables: Mapping[str, DataFrame], coder: Coder, theme_codes: DataFrame, scores: Coder | None = None, config: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Load, clean, code, cascade themes, and the tables of results by name; everything is lazy.

    ``coder`` gives segments (std_id, code_key, ...) of entries, ``scores`` (std_id,
    sentiment_score, emotions, ...) of them.
    """
    config = config or settings.loaded()
    entries = corpus(spark, tables, config)
    segments = coder(entries)
    results = coding.entry_results(entries, segments)
    membership = themes.cascade(segments, theme_codes)
    least = config["analysis"]["min_theme_entries"]
    out = {
        "entries": entries,
        "segments": segments,
        "codes": coding.codebook(segments),
        "results": results,
        "membership": membership,
        "coverage": coverage.coverage(entries, results, segments),
        "skips": coverage.skip_classes(results.where("skipped").select(F.col("skip_reason").alias("reason"))),
        "spread": themes.spread(membership.join(entries.select("std_id", "std_author"), "std_id"), "std_author", ["theme"]),
        "cooccurrence": association.cooccurrence(entries, membership, least),
        "network": association.network(membership),
        "keywords": themes.keywords(theme_codes, coding.codebook(segments).select("code_key", "frequency")),
    }
    if scores:
        scored = entries.join(coding.clamped_scores(scores(entries)), "std_id", "left")
        out |= {
            "sentiment": scored,
            "statistics": themes.statistics(scored, membership, "sentiment_score"),
            "prevalence": themes.enriched(scored, membership, "sentiment_score"),
            "groups": association.theme_comparison(scored, membership, ["sentiment_score"], least),
        }
    return out


def over_time(entries: DataFrame, membership: DataFrame, codes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Prevalence by the period that suits the span, and emergence; two jobs look at the time stamps first."""
    timed = temporal.parsed_timestamps(entries, "std_timestamp")
    out = {"prevalence": temporal.prevalence(timed, membership, "std_ts")}
    if codes is not None:
        out["emergence"] = temporal.emergence(timed, membership, codes, "std_ts")
    return out


def scaffold(entries: DataFrame, membership: DataFrame, categories: Sequence[str], attempts: DataFrame, skips: DataFrame) -> dict[str, DataFrame]:
    """People's themes questioned: what is open, what was covered, and themes' statistics."""
    spark = entries.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("category"))
    named = membership.select("theme").distinct()
    grid = coverage.attempt_grid(named, list(categories), attempts, skips)
    return {
        "open": lifecycle.open_questions(named, listed, attempts, skips),
        "grid": grid,
        "by_category": grid.groupBy("category").agg(F.sum("n_emitted").alias("n_emitted"), F.count_if(F.col("status") == "covered").alias("n_covered")),
        "spread": themes.spread(membership.join(entries.select("std_id", "std_author"), "std_id"), "std_author", ["theme"]),
    }


def compared(spark: SparkSession, base: str, models: bool = False, threshold: float = comparison.THRESHOLD) -> dict[str, DataFrame]:
    """The newest run of a folder against the one before it, or the latest of another model."""
    listed = runs.listed(spark, base)
    if models:
        roles = comparison.cross_model_pair(listed.select("run_id", "provider", F.col("model_primary").alias("model")))
    else:
        roles = comparison.current_and_previous(listed.select("run_id", F.col("analysis_schema_version").alias("schema_version")))
    ids = {r["role"]: r["run_id"] for r in roles.collect()}
    if set(ids) != {"current", "previous"}:
        raise ValueError("there are no two runs to compare")
    pick = lambda df, role: df.where(F.col("run_id") == ids[role])
    scores, books, named, found = runs.sentiment(spark, base), runs.codes(spark, base), runs.themes(spark, base), runs.correlations(spark, base)
    now, then = pick(scores, "current"), pick(scores, "previous")
    changes = comparison.theme_changes(pick(named, "current"), pick(named, "previous"), threshold)
    drift = comparison.sentiment_drift(now, then)
    return {
        "samples": comparison.samples(now, then),
        "sentiment": comparison.sentiment_by_run(scores),
        "emotions": comparison.top_emotions(scores),
        "drift": drift,
        "drift_summary": comparison.drift_summary(drift),
        "codes": comparison.code_changes(pick(books, "current"), pick(books, "previous"), threshold=threshold),
        "codes_across_runs": comparison.codes_across_runs(books),
        "themes": changes,
        "timeline": comparison.theme_timeline(named),
        "migration": comparison.migration(now, then),
        "stability": comparison.migration_stability(now, then, changes.where("status = 'persisted'").select("theme_curr", "theme_prev")),
        "correlations": comparison.correlation_stability(found.withColumnRenamed("correlation", "r")),
    }
