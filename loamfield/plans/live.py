"""Queries whose plan is a stream run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch
from ..streaming import live
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type AS theme, count(*) AS n FROM events GROUP BY ALL")
def stream_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.drained(live.prevalence(_events(spark, sf_dir), "ts", "event_type"), scratch(spark, "prevalence"))
    return rows.select(F.to_date("start").alias("day"), "theme", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS author, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.drained(live.sessions(_events(spark, sf_dir), "ts", "user_id", "60 minutes"), scratch(spark, "sessions"))
    return rows.select("author", "n")


@query("SELECT user_id % 3 AS corpus, event_type AS code_key, count(*) AS n FROM events GROUP BY ALL")
def stream_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _events(spark, sf_dir).select((F.col("user_id") % 3).alias("corpus"), F.col("event_type").alias("code_key"))
    rows = live.drained(live.growing_codebook(coded), scratch(spark, "codebook"), "update")
    return rows.groupBy("corpus", "code_key").agg(F.max("n").alias("n"))


@query("SELECT s.s AS start, event_type AS theme, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) o, LATERAL (SELECT date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END - o.k * INTERVAL 12 HOUR AS s) s GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence over windows of a day that start every twelve hours."""
    rows = live.drained(live.prevalence(_events(spark, sf_dir), "ts", "event_type", slide="12 hours"), scratch(spark, "sliding"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "theme", "n")


@query("SELECT event_type AS theme, count(*) AS n FROM events GROUP BY 1")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of the snapshots that a running aggregate leaves."""
    target = scratch(spark, "snapshots")
    live.snapshots(_events(spark, sf_dir).groupBy(F.col("event_type").alias("theme")).agg(F.count("*").alias("n")), target, f"{target}-checkpoint").awaitTermination()
    rows = spark.read.parquet(target)
    return rows.join(rows.agg(F.max("snapshot").alias("snapshot")), "snapshot").select("theme", "n")


@query("SELECT user_id, count(*) AS n_rows FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key is stored once, though it comes often and the stream is run twice."""
    target = scratch(spark, "inserts")
    for run in ("first", "second"):
        live.inserts(_events(spark, sf_dir).select("user_id", "event_type"), "user_id", target, f"{target}-{run}").awaitTermination()
    return spark.read.parquet(target).groupBy("user_id").agg(F.count("*").alias("n_rows"))
