"""Order statistics that no single task has to sort: ranks, running sums and exact quantiles.

A column's range is cut by a sketch into many narrow ranges; sums by range say what lies
before each, and only rows of one range meet in a task.  A sketch decides where rows go, never
what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that a column is cut into, and the sketch's accuracy (an error of 1 / ACCURACY of the rows).
RANGES, ACCURACY = 1024, 10_000


def same(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a frame that has a row a group; groups may be null."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    b = b.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in b.columns if c not in by))
    return a.join(b, [a[c].eqNullSafe(b[f"_{c}"]) for c in by], how).drop(*(f"_{c}" for c in by))


def range_of(value: Column, splits: Column) -> Column:
    """How many of the sorted ``splits`` are not beyond ``value``, by binary search."""
    steps = F.array(*(F.lit(1 << b) for b in range(RANGES.bit_length(), -1, -1)))
    n = F.size(splits)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.try_element_at(splits, low + step) <= value), low + step).otherwise(low))


def with_before(rows: DataFrame, value: str, weight: str, to: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the group's rows with smaller values; values are numbers, not null, once a group."""
    by = list(by)
    cuts = F.percentile_approx(F.col(value).cast("double"), [i / RANGES for i in range(1, RANGES)], ACCURACY)
    splits = rows.groupBy(*by).agg(cuts.alias("_splits"))
    placed = same(rows, splits, by).withColumn("_range", range_of(F.col(value).cast("double"), F.col("_splits"))).drop("_splits")
    sums = placed.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    # RANGES rows a group.
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*by, "_range", before.alias("_start"))
    within = F.coalesce(F.sum(weight).over(W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return same(placed.withColumn("_within", within), starts, [*by, "_range"]).withColumn(to, F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")


def quantiles(rows: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), to: str = "_q") -> DataFrame:
    """(by, to): exact quantiles of each group's values, interpolated between neighbours, as an array in the order of ``qs``.

    A sketch brackets each quantile; values below a bracket are counted, those inside, a few
    thousandths of the group, are ranked.  A group without values has nulls.
    """
    by, qs = list(by), list(qs)
    x, margin = F.col(value).cast("double"), 4 / ACCURACY
    ends = [max(0.0, q - margin) for q in qs] + [min(1.0, q + margin) for q in qs]
    sketch = rows.groupBy(*by).agg(F.percentile_approx(x, ends, ACCURACY).alias("_ends"), F.count(x).alias("_n"))
    valued = same(rows.where(x.isNotNull()).select(*by, x.alias("_x")), sketch, by)
    # Neighbours of a place lie within a bracket unless rows are few; then all of them do.
    whole = F.col("_n") <= ACCURACY
    low = [F.lit(float("-inf")) if ends[i] <= 0 else F.when(whole, float("-inf")).otherwise(F.col("_ends")[i]) for i in range(len(qs))]
    high = [F.lit(float("inf")) if ends[i + len(qs)] >= 1 else F.when(whole, float("inf")).otherwise(F.col("_ends")[i + len(qs)]) for i in range(len(qs))]
    below = valued.groupBy(*by).agg(F.array(*(F.count_if(F.col("_x") < a) for a in low)).alias("_below"), F.max("_n").alias("_n"))
    inside = F.array_compact(F.array(*(F.when((F.col("_x") >= a) & (F.col("_x") <= b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high, strict=True)))))
    counts = valued.select(*by, "_x", F.explode(inside).alias("_i")).groupBy(*by, "_i", "_x").agg(F.count("*").alias("_m"))
    within = F.coalesce(F.sum("_m").over(W.partitionBy(*by, "_i").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = same(counts.withColumn("_within", within), below, by)
    place = F.element_at(F.array(*map(F.lit, map(float, qs))), F.col("_i") + 1) * (F.col("_n") - 1)
    first = F.element_at("_below", F.col("_i") + 1) + F.col("_within")
    holds = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("_m")), F.col("_x")))
    ends_ = placed.withColumn("_place", place).groupBy(*by, "_i").agg(holds(F.floor("_place")).alias("_a"), holds(F.ceil("_place")).alias("_b"), F.max("_place").alias("_place"))
    share = F.col("_place") - F.floor("_place")
    found = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(F.col("_a") + share * (F.col("_b") - F.col("_a")))
    each = ends_.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", found.alias("_v")))), lambda e: e["_v"]).alias(to))
    return same(sketch.select(*by), each, by)
