"""The catalogue of 45 metric primitives.

A scalar primitive is an aggregate of one cleaned column; it is null where its definition
says so, and never an error.  Those that need a group's own centre (the median deviation,
outliers) take a second pass, which joins the centre back by group.  A distribution is a
frame of (label, n) in a declared order, zero-filled where its bins are fixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import quantiles, same
from .tails import shapiro_wilk

NEAR_ZERO = math.sqrt(2.220446049250313e-16)
MAD_SCALE = 1.4826
#: Values that a normality test looks at, at most; of more, those with the smallest hashes of value and number among equal values.
SHAPIRO_MOST = 5000
#: Numbers of one value that are made at a time.
SHAPIRO_RUN = 1 << 16


def cleaned(value: Column) -> Column:
    """Finite doubles; anything else is null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _guarded(least: int, x: Column, value: Column) -> Column:
    return F.when(F.count(x) >= least, value)


def _share(x: Column, test: Column) -> Column:
    return F.avg(F.when(x.isNotNull(), test.cast("double")))


def _variance_over_zero(x: Column) -> Column:
    return F.max(x) > F.min(x)


def _cv(x: Column) -> Column:
    return F.when((F.count(x) >= 2) & (F.abs(F.avg(x)) >= NEAR_ZERO), F.stddev_samp(x) / F.avg(x))


def _log(x: Column, value: Callable[[Column], Column], least: int) -> Column:
    return F.when((F.count(x) >= least) & (F.min(x) >= 0), value(F.log1p(F.when(x >= 0, x))))


def _hour_angle(t: Column) -> Column:
    return (F.hour(t) + F.minute(t) / 60) * (2 * math.pi / 24)


def _circular(x: Column) -> tuple[Column, Column]:
    return F.avg(F.sin(x)), F.avg(F.cos(x))


def _circular_mean(x: Column) -> Column:
    s, c = _circular(x)
    angle = F.atan2(s, c)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


@F.pandas_udf(T.DoubleType())
def _shapiro(values: pd.Series) -> pd.Series:
    return values.map(lambda v: (r := shapiro_wilk(v)) and r[1], na_action="ignore").astype("float64")


@dataclass(frozen=True)
class Metric:
    name: str
    family: str
    #: scalar, quantile (of exact quantiles), centred (a second pass), ordered (a window first), distribution, or test.
    shape: str
    kind: str = "numeric"
    #: Of a scalar the aggregate of a column; of a quantile the value from a function that gives the quantile at a share.
    build: Callable[..., Column] | None = None
    arguments: tuple[str, ...] = ()
    needs_many: bool = False


def _metric(name: str, family: str, build, arguments: tuple[str, ...] = (), kind: str = "numeric", shape: str = "scalar", many: bool = False) -> Metric:
    return Metric(name, family, shape, kind, build, arguments, many)


_LIST = [
    _metric("mean", "central", lambda x: F.avg(x)),
    _metric("median", "central", lambda at: at(0.5), shape="quantile"),
    _metric("mode_value", "central", lambda x: F.mode(x, True)),
    _metric("sd", "spread", lambda x: F.stddev_samp(x)),
    _metric("mad", "spread", None, shape="centred"),
    _metric("iqr", "spread", lambda at: at(0.75) - at(0.25), shape="quantile"),
    _metric("range_width", "spread", lambda x: F.max(x) - F.min(x)),
    _metric("cv", "spread", _cv, many=True),
    _metric("min", "spread", lambda x: F.min(x)),
    _metric("max", "spread", lambda x: F.max(x)),
    _metric("quantile", "quantile", lambda at, q: at(q), ("q",), shape="quantile"),
    *(_metric(f"p{p}", "quantile", lambda at, p=p: at(p / 100), shape="quantile", many=p in (10, 90, 95, 99)) for p in (10, 25, 75, 90, 95, 99)),
    _metric("n", "count", lambda x: F.count(x)),
    _metric("n_unique", "count", lambda x: F.countDistinct(x)),
    _metric("skewness", "shape", lambda x: F.when((F.count(x) >= 3) & _variance_over_zero(x), F.skewness(x)), many=True),
    _metric("kurtosis_excess", "shape", lambda x: F.when((F.count(x) >= 4) & _variance_over_zero(x), F.kurtosis(x)), many=True),
    _metric("log_mean", "heavy tail", lambda x: _log(x, F.avg, 1)),
    _metric("log_sd", "heavy tail", lambda x: _log(x, F.stddev_samp, 2)),
    _metric("outlier_count_iqr", "heavy tail", None, shape="centred", many=True),
    _metric("max_to_median_ratio", "heavy tail", lambda at: F.when(F.abs(at(0.5)) >= NEAR_ZERO, at(1.0) / at(0.5)), shape="quantile", many=True),
    _metric("proportion_zero", "proportion", lambda x: _share(x, x == 0)),
    _metric("proportion_nonzero", "proportion", lambda x: _share(x, x != 0)),
    _metric("proportion_above", "proportion", lambda x, threshold: _share(x, x > threshold), ("threshold",)),
    _metric("proportion_below", "proportion", lambda x, threshold: _share(x, x < threshold), ("threshold",)),
    _metric("proportion_in_range", "proportion", lambda x, low, high: _share(x, x.between(low, high)), ("low", "high")),
    _metric("entropy", "categorical", None, kind="categorical", shape="ordered"),
    _metric("frequency_distribution", "categorical", None, kind="categorical", shape="distribution"),
    _metric("top_k_values", "categorical", None, ("k",), kind="categorical", shape="distribution"),
    _metric("top3_values", "categorical", None, kind="categorical", shape="distribution"),
    _metric("hour_of_day_distribution", "temporal", None, kind="temporal", shape="distribution"),
    _metric("day_of_week_distribution", "temporal", None, kind="temporal", shape="distribution"),
    _metric("month_of_year_distribution", "temporal", None, kind="temporal", shape="distribution"),
    _metric("time_span_days", "temporal", lambda t: F.when(F.count(t) >= 2, (F.unix_micros(F.max(t).cast("timestamp")) - F.unix_micros(F.min(t).cast("timestamp"))) / 86400e6), kind="temporal"),
    _metric("median_seconds_between", "temporal", None, kind="temporal", shape="ordered"),
    _metric("entries_by_month", "temporal", None, kind="temporal", shape="distribution"),
    _metric("entries_over_time", "temporal", None, ("bin_width_days",), kind="temporal", shape="distribution"),
    _metric("circular_mean", "circular", _circular_mean, kind="angle"),
    _metric("circular_variance", "circular", lambda x: F.when(F.count(x) > 0, 1 - F.sqrt(F.pow(F.avg(F.sin(x)), 2) + F.pow(F.avg(F.cos(x)), 2))), kind="angle"),
    _metric("peak_hour_circular", "circular", lambda t: F.pmod(_circular_mean(_hour_angle(t)) * 24 / (2 * math.pi), F.lit(24.0)), kind="temporal"),
    _metric("shapiro_p", "test", None, shape="test", many=True),
]
CATALOGUE: dict[str, Metric] = {m.name: m for m in _LIST}


def names(family: str | None = None) -> list[str]:
    return [m.name for m in _LIST if family in (None, m.family)]


def described() -> str:
    """The catalogue as text, a line for each family."""
    families = dict.fromkeys(m.family for m in _LIST)
    return "\n".join(f"{f}: " + ", ".join(n if not CATALOGUE[n].arguments else f"{n}({', '.join(CATALOGUE[n].arguments)})" for n in names(f)) for f in families)


def described_values(df: DataFrame, value: str, metrics: Sequence[str | tuple[str, dict]], by: Sequence[str] = ()) -> DataFrame:
    """One row for each group with n_observed and a column for each metric that is one number.

    A metric is a name, or a name with its arguments.  A name outside the catalogue, or one of
    another shape, is an error before any job: nothing is put in its place.
    """
    asked = [(m, {}) if isinstance(m, str) else m for m in metrics]
    for name, args in asked:
        if name not in CATALOGUE or CATALOGUE[name].shape == "distribution":
            raise ValueError(f"{name} is no metric with one value")
        if set(args) != set(CATALOGUE[name].arguments):
            raise ValueError(f"{name} takes {CATALOGUE[name].arguments}")
    temporal = any(CATALOGUE[n].kind == "temporal" for n, _ in asked)
    if temporal and any(CATALOGUE[n].kind != "temporal" for n, _ in asked):
        raise ValueError("temporal metrics and others are asked for one by one")
    by = list(by)
    column = F.col(value) if temporal or any(CATALOGUE[n].kind == "categorical" for n, _ in asked) else cleaned(F.col(value))
    rows = df.select(*by, column.alias("_x"))
    x = F.col("_x")
    plain = [CATALOGUE[n].build(x, **a).alias(n) for n, a in asked if CATALOGUE[n].shape == "scalar"]
    out = rows.groupBy(*by).agg(F.count(x).alias("n_observed"), *plain)
    ranked = [(n, a) for n, a in asked if CATALOGUE[n].shape == "quantile"]
    if ranked:
        out = _with_quantiles(out, rows, by, ranked)
    for name, _ in asked:
        second = _SECOND.get(name)
        if second:
            out = same(out, second(rows, by), by)
    return out.select(*by, "n_observed", *(n for n, _ in asked))


def _with_quantiles(out: DataFrame, rows: DataFrame, by: list[str], asked: list[tuple[str, dict]]) -> DataFrame:
    """``out`` with metrics made of quantiles, all of them found in one go; a share outside 0 to 1 is null."""
    shares: list[float] = []

    def at(q: float) -> Column:
        if not 0 <= q <= 1:
            return F.lit(None).cast("double")
        if q not in shares:
            shares.append(q)
        return F.col("_q")[shares.index(q)]

    values = {name: CATALOGUE[name].build(at, **args) for name, args in asked}
    found = quantiles(rows, "_x", shares, by) if shares else rows.groupBy(*by).agg(F.lit(None).cast("array<double>").alias("_q"))
    return same(out, found, by).withColumns(values).drop("_q")


def _mad(rows: DataFrame, by: list[str]) -> DataFrame:
    centre = quantiles(rows, "_x", [0.5], by)
    away = same(rows, centre, by).select(*by, F.abs(F.col("_x") - F.col("_q")[0]).alias("_x"))
    return quantiles(away, "_x", [0.5], by).select(*by, (MAD_SCALE * F.col("_q")[0]).alias("mad"))


def _outliers(rows: DataFrame, by: list[str]) -> DataFrame:
    quarter = quantiles(rows, "_x", [0.25, 0.75], by).select(*by, F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
    beyond = (F.col("_x") < F.col("_a") - 1.5 * (F.col("_b") - F.col("_a"))) | (F.col("_x") > F.col("_b") + 1.5 * (F.col("_b") - F.col("_a")))
    return same(rows, quarter, by).groupBy(*by).agg(F.when(F.count("_x") >= 4, F.count_if(beyond)).alias("outlier_count_iqr"))


def _entropy(rows: DataFrame, by: list[str]) -> DataFrame:
    counts = rows.where("_x IS NOT NULL").groupBy(*by, "_x").count()
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_n"))
    p = F.col("count") / F.col("_n")
    return same(counts, totals, by).groupBy(*by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def _gaps(rows: DataFrame, by: list[str]) -> DataFrame:
    # A global order needs all rows in one place, so days are gapped apart first: within a day, then across days by their ends.
    t = rows.where("_x IS NOT NULL").select(*by, F.unix_micros(F.col("_x").cast("timestamp")).alias("_t")).withColumn("_day", F.col("_t").cast("long") / F.lit(86_400_000_000))
    t = t.withColumn("_day", F.floor("_day"))
    within = t.select(*by, (F.col("_t") - F.lag("_t").over(W.partitionBy(*by, "_day").orderBy("_t"))).alias("_gap")).where("_gap IS NOT NULL")
    # A row a day.
    ends = t.groupBy(*by, "_day").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    across = ends.select(*by, (F.col("_first") - F.lag("_last").over(W.partitionBy(*by or [F.lit(0)]).orderBy("_day"))).alias("_gap")).where("_gap IS NOT NULL")
    return quantiles(within.unionByName(across), "_gap", [0.5], by).select(*by, (F.col("_q")[0] / 1e6).alias("median_seconds_between"))


def _shapiro_by(rows: DataFrame, by: list[str]) -> DataFrame:
    # A row is its value and its number among equal values; the numbers are made from counts, in runs, so that no task holds a value's rows.
    counts = rows.where("_x IS NOT NULL").groupBy(*by, "_x").agg(F.count("*").alias("_m"))
    sizes = counts.groupBy(*by).agg(F.sum("_m").alias("_n"), F.count("*").alias("_kinds"))
    runs = same(counts, sizes, by).where("_kinds >= 3").select(*by, "_x", "_m", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / SHAPIRO_RUN))).alias("_run"))
    number = F.sequence(F.col("_run") * SHAPIRO_RUN, F.least(F.col("_m"), (F.col("_run") + 1) * SHAPIRO_RUN) - 1)
    each = runs.repartition(*by, "_x", "_run").select(*by, "_x", "_n", F.explode(number).alias("_k")).withColumn("_hash", F.xxhash64("_x", "_k"))
    # Twice the rows wanted are ordered, of any number of rows.
    few = each.where((F.col("_n") <= 2 * SHAPIRO_MOST) | (F.pmod("_hash", F.lit(1 << 40)).cast("double") * F.col("_n") < F.lit(float(2 * SHAPIRO_MOST << 40))))
    chosen = few.withColumn("_rank", F.row_number().over(W.partitionBy(*by or [F.lit(0)]).orderBy("_hash", "_x", "_k"))).where(f"_rank <= {SHAPIRO_MOST}")
    return chosen.groupBy(*by).agg(F.collect_list("_x").alias("_v")).select(*by, _shapiro("_v").alias("shapiro_p"))


_SECOND: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "mad": _mad,
    "outlier_count_iqr": _outliers,
    "entropy": _entropy,
    "median_seconds_between": _gaps,
    "shapiro_p": _shapiro_by,
}

DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def frequencies(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, n) of the values that aren't null."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("label")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, value: str, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, n, place) of the ``k`` most frequent values, the smaller first among equals."""
    counts = frequencies(df, value, by)
    if not by:
        best = counts.orderBy(F.desc("n"), "label").limit(k)
        return best.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label")))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "label"))).where(F.col("place") <= k)


def binned(df: DataFrame, ts: str, bins: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, label, n) over all fixed bins: ``hour``, ``weekday`` from Monday, or ``month``, zero-filled."""
    spark = df.sparkSession
    of, labels = {
        "hour": (F.hour(ts), [f"{h:02d}" for h in range(24)]),
        "weekday": (F.weekday(ts), DAYS),
        "month": (F.month(ts) - 1, MONTHS),
    }[bins]
    spine = spark.range(len(labels)).select(F.col("id").cast("int").alias("bin"), F.element_at(F.array(*map(F.lit, labels)), F.col("id").cast("int") + 1).alias("label"))
    counts = df.where(F.col(ts).isNotNull()).groupBy(*by, of.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = counts.select(*by).distinct().crossJoin(F.broadcast(spine)) if by else spine
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entries_by_month(df: DataFrame, ts: str, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """(by, label, n) by month ``yyyy-MM``; with ``dense`` the months between a group's first and last are zero-filled."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(*by, F.trunc(ts, "month").alias("month")).agg(F.count("*").alias("n"))
    if dense:
        spine = counts.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b")).select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
        counts = spine.join(counts, [*by, "month"], "left")
    return counts.select(*by, F.date_format("month", "yyyy-MM").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entries_over_time(df: DataFrame, ts: str, bin_width_days: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, n) in bins of so many days from the group's first entry; the label is the bin's first date."""
    if bin_width_days <= 0:
        raise ValueError("bin_width_days is over 0")
    width = int(bin_width_days * 86_400_000_000)
    t = df.where(F.col(ts).isNotNull()).select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    first = t.groupBy(*by).agg(F.min("_t").alias("_first"))
    placed = same(t, first, list(by)).withColumn("_bin", F.floor((F.col("_t") - F.col("_first")) / width))
    label = F.date_format(F.timestamp_micros(F.col("_first") + F.col("_bin") * width), "yyyy-MM-dd")
    return placed.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))
