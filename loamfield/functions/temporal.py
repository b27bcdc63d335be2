"""Time stamps, periods and themes over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The formats tried, and the spans in days under which a period is used.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
)
PERIODS = (("daily", 30), ("weekly", 180), ("monthly", 730), ("quarterly", None))


def _stripped(text: Column) -> Column:
    text = F.regexp_replace(text, r"^(.*?)\.[0-9]+", "$1")
    return F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"[+-][0-9]{2}:[0-9]{2}$", "")


def parsed_timestamps(df: DataFrame, column: str, to: str = "std_ts", formats: Sequence[str] = FORMATS) -> DataFrame:
    """``df`` with ``column`` parsed to a TIMESTAMP_NTZ ``to`` by the one format that parses most values.

    Fractions, a trailing Z and an offset are dropped, not applied.  Of formats that parse as
    many, the first is taken.  What it doesn't parse is null.
    """
    text = _stripped(F.when(~F.col(column).isin("", "NA"), F.col(column)))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    counts = df.agg(*(F.count(t).alias(str(i)) for i, t in enumerate(tries))).first()
    best = max(range(len(formats)), key=lambda i: (counts[i], -i))
    return df.withColumn(to, tries[best].cast("timestamp_ntz"))


def ambiguous_dates(df: DataFrame, column: str) -> DataFrame:
    """Values that month-first and day-first dates read as different days."""
    text = _stripped(F.col(column))
    a, b = (F.try_to_timestamp(text, F.lit(f)) for f in ("MM/dd/yyyy", "dd/MM/yyyy"))
    return df.where(a.isNotNull() & b.isNotNull() & (a != b))


def period_of_span(first: Column, last: Column, n: Column) -> Column:
    """The period that suits a span of time; daily with fewer than two time stamps."""
    days = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86400e6
    out = F.when(n < 2, "daily")
    for name, most in PERIODS[:-1]:
        out = out.when(days < most, name)
    return out.otherwise(PERIODS[-1][0])


def detected_period(df: DataFrame, ts: str) -> str:
    """The period for the whole table: one small aggregate."""
    return df.agg(period_of_span(F.min(ts), F.max(ts), F.count(ts)).alias("p")).first()["p"]


def period_label(ts: Column, period: str) -> Column:
    """Day, ISO week, month or quarter; null stays null."""
    if period == "weekly":
        year = F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0")
        return F.when(ts.isNotNull(), F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")))
    if period == "monthly":
        return F.date_format(ts, "yyyy-MM")
    if period == "quarterly":
        return F.when(ts.isNotNull(), F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string")))
    return F.date_format(ts, "yyyy-MM-dd")


def prevalence(entries: DataFrame, themes: DataFrame, ts: str, period: str | None = None, key: str = "std_id", theme: str = "theme") -> DataFrame:
    """(period, theme, n, total, pct) over the dense grid of periods and themes.

    ``entries`` has one row an entry (key, ts), ``themes`` the pairs (key, theme).  total is
    the entries of a period, with or without themes; pct has two decimals.  Entries without a
    time stamp are on no period.
    """
    period = period or detected_period(entries, ts)
    placed = entries.where(F.col(ts).isNotNull()).select(key, period_label(F.col(ts), period).alias("period"))
    totals = placed.groupBy("period").agg(F.count("*").alias("total"))
    counts = placed.join(themes.select(key, theme).distinct(), key).groupBy("period", theme).agg(F.count("*").alias("n"))
    grid = totals.crossJoin(F.broadcast(themes.select(theme).distinct()))  # periods by themes, both dimensions
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(counts, ["period", theme], "left").select("period", theme, n.alias("n"), "total", F.round(100 * n / F.col("total"), 2).alias("pct"))


def labelled_prevalence(entries: DataFrame, ts: str, theme: Column, period: str) -> DataFrame:
    """As :func:`prevalence` where each entry has one theme: one aggregate, no join of entries."""
    counts = entries.where(F.col(ts).isNotNull()).groupBy(period_label(F.col(ts), period).alias("period"), theme.alias("theme")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("period").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(counts.where("theme IS NOT NULL").select("theme").distinct()))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(counts, ["period", "theme"], "left").select("period", "theme", n.alias("n"), "total", F.round(100 * n / F.col("total"), 2).alias("pct"))


def emergence(entries: DataFrame, themes: DataFrame, codes: DataFrame, ts: str, key: str = "std_id", theme: str = "theme") -> DataFrame:
    """(theme, first_seen, n_entries, first_code, codes_at_emergence), one row a theme.

    ``codes`` has (theme, code, birth_id): the entry in which a code came up first.  A code
    counts at emergence when it was born at the time the theme's first code was.
    """
    times = entries.select(key, F.col(ts).alias("_ts"))
    seen = themes.select(key, theme).distinct().join(times, key).groupBy(theme).agg(F.min("_ts").alias("first_seen"), F.count("*").alias("n_entries"))
    born = codes.join(times.withColumnRenamed(key, "birth_id"), "birth_id", "left").select(theme, "code", "_ts")
    least = born.groupBy(theme).agg(F.min("_ts").alias("first_code"))
    at = born.join(least, theme).groupBy(theme).agg(F.max("first_code").alias("first_code"), F.count_if(F.col("_ts") == F.col("first_code")).alias("codes_at_emergence"))
    return seen.join(at, theme, "left")


def epoch_to_timestamp(df: DataFrame, column: str, to: str = "std_timestamp") -> DataFrame:
    """A numeric column as ISO text if its first value (by row_ord) is an epoch in seconds, else as it is, cast to text."""
    first = df.where(F.col(column).isNotNull()).agg(F.min_by(column, "row_ord").alias("v")).first()["v"]
    epoch = first is not None and 1e9 < float(first) < 2e10
    text = F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd HH:mm:ss") if epoch else F.col(column).cast("string")
    return df.withColumn(to, text)


def running_count(ordered_by: str, by: Sequence[str] = ()) -> Column:
    return F.sum(F.lit(1)).over(W.partitionBy(*by).orderBy(ordered_by).rowsBetween(W.unboundedPreceding, 0))
