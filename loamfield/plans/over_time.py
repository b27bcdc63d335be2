"""Queries on themes over time and their contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, temporal
from ..operators import themes
from .registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""
WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS period, event_type AS theme FROM events WHERE ts IS NOT NULL),
t AS (SELECT period, count(*) AS total FROM p GROUP BY period), k AS (SELECT DISTINCT theme FROM p WHERE theme IS NOT NULL),
c AS (SELECT period, theme, count(*) AS n FROM p GROUP BY ALL)
SELECT period, theme, coalesce(n, 0)::BIGINT AS n, total, round(100.0 * coalesce(n, 0) / total, 2)::DOUBLE AS pct
FROM t CROSS JOIN k LEFT JOIN c USING (period, theme)
""")
def theme_prevalence_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grid of days and themes: which themes dominate over time."""
    return temporal.labelled_prevalence(_events(spark, sf_dir), "ts", F.col("event_type"), "daily")


@query("""
WITH p AS (SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS period, o_orderpriority AS theme FROM orders),
t AS (SELECT period, count(*) AS total FROM p GROUP BY period), k AS (SELECT DISTINCT theme FROM p), c AS (SELECT period, theme, count(*) AS n FROM p GROUP BY ALL)
SELECT period, theme, coalesce(n, 0)::BIGINT AS n, total, round(100.0 * coalesce(n, 0) / total, 2)::DOUBLE AS pct
FROM t CROSS JOIN k LEFT JOIN c USING (period, theme)
""")
def theme_prevalence_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period is detected from the span (years of orders give quarters); themes come as pairs."""
    orders = table(spark, sf_dir, "orders")
    pairs = orders.select(F.col("o_orderkey").alias("std_id"), F.col("o_orderpriority").alias("theme"))
    return temporal.prevalence(orders.withColumnRenamed("o_orderkey", "std_id"), pairs, "o_orderdate")


@query("""
SELECT CASE WHEN count(ts) < 2 OR epoch(max(ts) - min(ts)) / 86400 < 30 THEN 'daily' WHEN epoch(max(ts) - min(ts)) / 86400 < 180 THEN 'weekly'
            WHEN epoch(max(ts) - min(ts)) / 86400 < 730 THEN 'monthly' ELSE 'quarterly' END AS period, event_type FROM events GROUP BY event_type
""")
def detected_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(temporal.period_of_span(F.min("ts"), F.max("ts"), F.count("ts")).alias("period"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS daily, isoyear(o_orderdate)::VARCHAR || '-W' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS weekly,
       strftime(o_orderdate, '%Y-%m') AS monthly, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarterly, count(*) AS n
FROM orders GROUP BY ALL
""")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(*(temporal.period_label(day, p).alias(p) for p in ("daily", "weekly", "monthly", "quarterly"))).agg(F.count("*").alias("n"))


_GINI = """
WITH c AS (SELECT {by}, {author} AS a, count(*) AS x FROM {table} WHERE trim({author}::VARCHAR) <> '' GROUP BY ALL),
r AS (SELECT {by}, x, row_number() OVER (PARTITION BY {by} ORDER BY x) AS i FROM c)
SELECT {by}, count(*) AS n_contributors, sum(x)::BIGINT AS n_entries, round(max(x) / sum(x), 9) AS top_share,
       round(CASE WHEN count(*) >= 2 THEN greatest(0, least(1, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*))) END, 9)::DOUBLE AS gini
FROM r GROUP BY {by}
"""


@query(_GINI.format(by="event_type", author="user_id", table="events"))
def participant_spread_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated each theme's contributors are."""
    out = themes.spread(_events(spark, sf_dir), "user_id", ["event_type"])
    return out.withColumns({c: F.round(c, 9) for c in ("top_share", "gini")})


@query("""
SELECT lang, count(*) AS n_contributors, max(x) / sum(x) > 0.5 AS dominated FROM (SELECT lang, source, count(*) AS x FROM documents GROUP BY ALL) GROUP BY lang
""")
def spread_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.spread_warning(themes.spread(table(spark, sf_dir, "documents"), "source", ["lang"]))
    return out.select("lang", "n_contributors", (F.coalesce("warning", F.lit("")) == "dominant_contributor").alias("dominated"))


@query("""
WITH e AS (SELECT event_id, ts, event_type, event_type || ':' || (user_id % 7) AS code FROM events),
b AS (SELECT event_type, code, arg_min(event_id, (ts, event_id)) AS birth FROM e GROUP BY ALL),
t AS (SELECT b.*, e.ts FROM b JOIN e ON e.event_id = b.birth),
f AS (SELECT event_type, min(ts) AS first_code FROM t GROUP BY ALL)
SELECT e.event_type AS theme, min(e.ts) AS first_seen, count(*) AS n_entries, any_value(first_code) AS first_code,
       any_value((SELECT count(*) FROM t WHERE t.event_type = f.event_type AND t.ts = f.first_code)) AS codes_at_emergence
FROM e JOIN f USING (event_type) GROUP BY e.event_type
""")
def theme_emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    entries = events.select(F.col("event_id").alias("std_id"), "ts")
    pairs = events.select(F.col("event_id").alias("std_id"), F.col("event_type").alias("theme"))
    code = F.concat("event_type", F.lit(":"), (F.col("user_id") % 7).cast("string"))
    births = events.groupBy(F.col("event_type").alias("theme"), code.alias("code")).agg(F.min(F.struct("ts", "event_id")).alias("b"))
    return temporal.emergence(entries, pairs, births.select("theme", "code", F.col("b.event_id").alias("birth_id")), "ts")


@query("""
SELECT event_type, h.h AS bin, lpad(h.h::VARCHAR, 2, '0') AS label, count(e.ts) AS n
FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(24))::INT AS h) h
LEFT JOIN events e ON e.event_type = event_type_1 AND hour(e.ts) = h.h GROUP BY ALL
""".replace("(SELECT DISTINCT event_type FROM events)", "(SELECT DISTINCT event_type AS event_type_1 FROM events) k").replace("SELECT event_type, h.h", "SELECT event_type_1 AS event_type, h.h"))
def hour_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned(_events(spark, sf_dir), "ts", "hour", ["event_type"])


_BINS = """
SELECT b.bin::INT AS bin, [{labels}][b.bin + 1] AS label, count(e.d) AS n FROM (SELECT unnest(range({k})) AS bin) b
LEFT JOIN (SELECT {of} AS d FROM {table}) e ON e.d = b.bin GROUP BY ALL
"""


@query(_BINS.format(labels=", ".join(f"'{d}'" for d in metrics.DAYS), k=7, of="isodow(ts) - 1", table="events"))
def weekday_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned(_events(spark, sf_dir), "ts", "weekday")


@query(_BINS.format(labels=", ".join(f"'{d}'" for d in metrics.MONTHS), k=12, of="month(o_orderdate) - 1", table="orders"))
def month_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned(table(spark, sf_dir, "orders"), "o_orderdate", "month")


@query("""
WITH g AS (SELECT event_type, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events)
SELECT event_type, count(*) AS n_observed, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 6) AS time_span_days, round(quantile_cont(gap, 0.5) / 1e6, 6) AS median_seconds_between
FROM g GROUP BY event_type
""")
def span_and_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.described_values(_events(spark, sf_dir), "ts", ["time_span_days", "median_seconds_between"], ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("time_span_days", "median_seconds_between")})


@query("""
WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT p, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM m GROUP BY p)
SELECT p AS o_orderpriority, strftime(m, '%Y-%m') AS label, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN m USING (p, m)
""")
def entries_by_month_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of all orders by priority, months without entries included."""
    return metrics.entries_by_month(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderpriority"], dense=True)


@query("""
WITH f AS (SELECT min(ts) AS a FROM events)
SELECT strftime(a + floor((epoch_us(ts) - epoch_us(a)) / 604800000000)::BIGINT * INTERVAL 7 DAY, '%Y-%m-%d') AS label, count(*) AS n FROM events, f GROUP BY 1
""")
def entries_over_time_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks from the first entry on."""
    return metrics.entries_over_time(_events(spark, sf_dir), "ts", 7)


@query("""
WITH a AS (SELECT event_type, (hour(ts) + minute(ts) / 60) * 2 * pi() / 24 AS x FROM events),
s AS (SELECT event_type, avg(sin(x)) AS s, avg(cos(x)) AS c, count(*) AS n FROM a GROUP BY 1)
SELECT event_type, n AS n_observed, round(((CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END) * 24 / (2 * pi())) % 24, 6) AS peak_hour FROM s
""")
def circular_peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.described_values(_events(spark, sf_dir), "ts", ["peak_hour_circular"], ["event_type"])
    return out.select("event_type", "n_observed", F.round("peak_hour_circular", 6).alias("peak_hour"))


@query("""
WITH s AS (SELECT event_type, avg(sin(value)) AS s, avg(cos(value)) AS c FROM events GROUP BY 1)
SELECT event_type, round(CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END, 6) AS circular_mean, round(1 - sqrt(s * s + c * c), 6) AS circular_variance FROM s
""")
def circular_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.described_values(_events(spark, sf_dir), "value", ["circular_mean", "circular_variance"], ["event_type"])
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("circular_mean", "circular_variance")))


@query("""
SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS std_ts FROM events
""")
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps as text with fractions and an offset, which is dropped, parsed by the format that fits most."""
    text = _events(spark, sf_dir).select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250+02:00")).alias("std_timestamp"))
    return temporal.parsed_timestamps(text, "std_timestamp").select("event_id", "std_ts")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS std_timestamp FROM events
""")
def standardize_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds recognised by the first value and turned into text."""
    rows = _events(spark, sf_dir).select("event_id", F.col("event_id").alias("row_ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created"))
    return temporal.epoch_to_timestamp(rows, "created").select("event_id", "std_timestamp")
