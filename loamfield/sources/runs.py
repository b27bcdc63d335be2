"""Run folders read back: snapshots, listings, logs, memos, checkpoints and cached responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.comparison import compatible_schema

# The name of a run's folder, and schemas of its files.
RUN_ID = r"(run_\d{4}-\d{2}-\d{2}_\d{6}(?:_M[123])?)"
SENTIMENT = "std_id string, std_text string, sentiment_score double, all_emotions string, emotion_intensity double, confidence double, emerged_themes string, source_table string"
CODES = "code_key string, code_text string, code_type string, frequency int, n_entries int"
CORRELATIONS = "var1 string, var2 string, correlation double, p_value double, effect_size string, significant boolean, ci_lower double, ci_upper double"
THEME = "name string, description string, entry_count int, prevalence string, sentiment_tendency string, codes_included string"
METADATA = "run_id string, provider string, model_primary string, model_fast string, timestamp string, config_hash string, study_name string, analysis_schema_version string"


def run_of(path: Column) -> Column:
    return F.regexp_extract(path, RUN_ID, 1)


def _csv(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """One kind of table of all runs, lines of ``#`` left out, with the run of each row."""
    rows = spark.read.schema(schema).option("header", "true").option("comment", "#").option("multiLine", "true").option("escape", '"').csv(f"{base}/run_*/{name}")
    return rows.withColumn("run_id", run_of(F.col("_metadata.file_path")))


def sentiment(spark: SparkSession, base: str) -> DataFrame:
    return _csv(spark, base, "sentiment_scores.csv", SENTIMENT)


def codes(spark: SparkSession, base: str, name: str = "codes.csv") -> DataFrame:
    return _csv(spark, base, name, CODES)


def correlations(spark: SparkSession, base: str) -> DataFrame:
    return _csv(spark, base, "correlations.csv", CORRELATIONS)


def themes(spark: SparkSession, base: str) -> DataFrame:
    """Themes of all runs, with or without a stamp's envelope around them; codes as an array."""
    files = spark.read.text(f"{base}/run_*/themes.json", wholetext=True).select(run_of(F.col("_metadata.file_path")).alias("run_id"), "value")
    inner = F.coalesce(F.get_json_object("value", "$._payload"), F.col("value"))
    inner = F.coalesce(F.get_json_object(inner, "$.themes"), inner)
    rows = files.select("run_id", F.explode(F.from_json(inner, f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in THEME.split(', '))}>>")).alias("t")).select("run_id", "t.*")
    return rows.withColumn("codes", F.filter(F.transform(F.split(F.coalesce("codes_included", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def listed(spark: SparkSession, base: str) -> DataFrame:
    """Runs with their metadata and whether their schema can be compared."""
    rows = spark.read.schema(METADATA).option("multiLine", "true").json(f"{base}/run_*/run_metadata.json")
    return rows.withColumn("run_id", F.coalesce(F.nullif(run_of(F.col("_metadata.file_path")), F.lit("")), "run_id")).withColumn("compatible", compatible_schema(F.col("analysis_schema_version")))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed fields of a log of JSON lines, and the others as a map."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    every = F.from_json("value", "map<string,string>")
    known = ("timestamp", "step", "decision_type", "methodology_mode", "schema_version")
    return lines.select(*(F.get_json_object("value", f"$.{k}").alias(k) for k in known), F.map_filter(every, lambda k, v: ~k.isin(*known)).alias("extras"))


def memos(spark: SparkSession, folder: str) -> DataFrame:
    """(path, type, author, themes, body) of Markdown notes with a header between ``---`` lines."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    linked = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(field("themes"), F.lit("")), r"[\[\]\"]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return files.select("path", field("type").alias("type"), field("author").alias("author"), linked.alias("themes"), F.btrim(F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 2), F.lit(" \t\r\n")).alias("body"))


def latest_checkpoint(spark: SparkSession, folder: str, step: str) -> DataFrame | None:
    """A step's full table, else its partial one, else none; an unreadable one counts as none."""
    for kind in ("full", "partial"):
        try:
            df = spark.read.parquet(f"{folder}/{step}.{kind}")
            df.schema  # noqa: B018
            return df
        except Exception:  # noqa: BLE001 - whatever is wrong with it, the step is computed anew
            continue
    return None


def cached_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts with the response stored for their hash, null without one."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(responses.select("prompt_hash", "response"), "prompt_hash", "left")


def new_responses(responses: DataFrame, stored: DataFrame) -> DataFrame:
    """Responses whose prompt isn't stored: the first is kept, later ones never replace it."""
    return responses.dropDuplicates(["prompt_hash"]).join(stored.select("prompt_hash"), "prompt_hash", "left_anti")
