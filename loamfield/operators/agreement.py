"""Agreement of two coders: set distances, percent agreement, alpha, kappa and their bands."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import jaro, label_set, set_jaccard

# Sample of a verification, slots of a sheet, distance of one label from another, resamples.
SAMPLE, SLOTS, FUZZY, RESAMPLES, SEED = 20, 8, 0.15, 2000, 42
#: Different sets of labels whose pairs are formed, at most.
MOST_KINDS = 20_000
KAPPA_BANDS = ((0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight"))


def sampled(df: DataFrame, key: str, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``n`` rows by the order of a digest of seed and key: the same rows on any engine."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def coding_sheet(entries: DataFrame, codes: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """Entries with columns code_1 .. code_n: blank for a person, or filled from (std_id, code) in order of names."""
    if codes is None:
        return entries.withColumns({f"code_{i}": F.lit(None).cast("string") for i in range(1, slots + 1)})
    sets = codes.groupBy("std_id").agg(F.array_sort(F.collect_set("code")).alias("_c"))
    return entries.join(sets, "std_id", "left").withColumns({f"code_{i}": F.get(F.col("_c"), i - 1) for i in range(1, slots + 1)}).drop("_c")


def sheet_sets(sheet: DataFrame, key: str = "std_id") -> DataFrame:
    """(key, labels) of a wide sheet; of a repeated key the first row by its labels counts."""
    columns = [c for c in sheet.columns if c.startswith("code_")]
    rows = sheet.select(key, label_set(F.array_compact(F.array(*columns))).alias("labels"))
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(F.array_join("labels", "\0")))).where("_i = 1").drop("_i")


def canonical_labels(labels: Sequence[str], threshold: float = FUZZY) -> dict[str, str]:
    """Each label's representative: the first earlier one within the Jaro distance, in the order given."""
    kept: list[str] = []
    out = {}
    for x in labels:
        out[x] = next((k for k in kept if 1 - jaro(x, k) <= threshold), x)
        if out[x] == x and x not in kept:
            kept.append(x)
    return out


def paired(a: DataFrame, b: DataFrame, key: str = "std_id") -> DataFrame:
    """(key, a, b) of the label sets of two coders for the entries that both have."""
    return a.select(key, F.col("labels").alias("a")).join(b.select(key, F.col("labels").alias("b")), key)


def set_distance(a: Column, b: Column) -> Column:
    return 1 - set_jaccard(a, b, 1.0)


def percent_agreement(pairs: DataFrame) -> DataFrame:
    same = F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(same).alias("n_agree"), F.avg(same.cast("double")).alias("agreement"))


def set_alpha(pairs: DataFrame) -> DataFrame:
    """(n, observed, expected, alpha) with Jaccard distances between sets; null with fewer than two entries.

    The expected distance is over all pairs of the pooled 2n sets.  It is taken on distinct
    sets with their counts, so the pairs don't grow with entries; more than MOST_KINDS
    different sets are an error.
    """
    observed = pairs.agg(F.count("*").alias("n"), F.avg(set_distance(F.col("a"), F.col("b"))).alias("observed"))
    pooled = pairs.select(F.explode(F.array(F.struct(F.array_sort(F.array_distinct("a")).alias("s")), F.struct(F.array_sort(F.array_distinct("b")).alias("s")))).alias("x"))
    kinds = pooled.groupBy("x.s").agg(F.count("*").alias("k"))
    if kinds.limit(MOST_KINDS + 1).count() > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} different sets of labels")
    other = kinds.select(F.col("s").alias("s2"), F.col("k").alias("k2"))
    d = set_distance(F.col("s"), F.col("s2")) * F.col("k") * F.col("k2")
    total = kinds.crossJoin(other).agg(F.sum(d).alias("d"), F.sum(F.col("k") * F.col("k2")).alias("w"), F.sum(F.when(F.col("s") == F.col("s2"), F.col("k"))).alias("self"))
    expected = F.try_divide(F.col("d"), F.col("w") - F.col("self"))
    both = observed.crossJoin(total).withColumn("expected", expected)
    alpha = F.when(F.col("n") >= 2, F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).otherwise(1.0))
    return both.select("n", "observed", "expected", alpha.alias("alpha"))


def kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, observed, expected, kappa) of two 0/1 raters; null where chance alone agrees fully."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = pairs.where(x.isNotNull() & y.isNotNull())
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("observed"), (F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def mean_code_kappa(pairs: DataFrame) -> DataFrame:
    """(n_codes, kappa): mean kappa over the codes that either coder used and that vary."""
    codes = pairs.select(F.explode(F.array_union("a", "b")).alias("code")).distinct()
    n = pairs.agg(F.count("*").alias("n"))
    used = pairs.select(F.explode(F.array_union("a", "b")).alias("code"), "a", "b")
    flags = used.groupBy("code").agg(
        F.count_if(F.array_contains("a", F.col("code")) & F.array_contains("b", F.col("code"))).alias("both"),
        F.count_if(F.array_contains("a", F.col("code"))).alias("na"),
        F.count_if(F.array_contains("b", F.col("code"))).alias("nb"),
    )
    rows = codes.join(flags, "code").crossJoin(F.broadcast(n))  # n is one row
    pa, pb = F.col("na") / F.col("n"), F.col("nb") / F.col("n")
    observed = (F.col("both") + F.col("n") - F.col("na") - F.col("nb") + F.col("both")) / F.col("n")
    expected = pa * pb + (1 - pa) * (1 - pb)
    varies = (F.col("na") + F.col("nb") > 0) & (F.col("na") + F.col("nb") < 2 * F.col("n"))
    return rows.where(varies & (expected < 1)).agg(F.count("*").alias("n_codes"), F.avg((observed - expected) / (1 - expected)).alias("kappa"))


def nominal_alpha(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Krippendorff's alpha of two nominal raters."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    observed = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) != F.col(b)).cast("double")).alias("do"))
    values = rows.select(F.explode(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    de = values.agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("s")).select((1 - F.try_divide(F.col("s") - F.col("m"), F.col("m") * (F.col("m") - 1))).alias("de"))
    return observed.crossJoin(de).select("n", F.when(F.col("de") > 0, 1 - F.col("do") / F.col("de")).otherwise(1.0).alias("alpha"))


def bootstrap_alpha(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, least: int = 8, most: int = 2000) -> DataFrame:
    """(n, lower, upper): the percentile interval of set alpha over resampled entries.

    A verification sample is a few dozen entries that a person has coded; more than ``most``
    are an error, not cut.  Resamples run in parallel, each from a generator of its own seed.
    """
    rows = pairs.select(F.array_sort("a").alias("a"), F.array_sort("b").alias("b")).orderBy(F.to_json(F.struct("a", "b"))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a verification sample has at most {most} entries")
    spark, n = pairs.sparkSession, len(rows)
    if n < least:
        return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    sets = [frozenset(r["a"]) for r in rows] + [frozenset(r["b"]) for r in rows]
    far = np.array([[1 - len(x & y) / len(x | y) if x | y else 0.0 for y in sets] for x in sets])

    def alphas(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                pick = np.random.default_rng((seed, int(i))).integers(0, n, n)
                both = np.concatenate([pick, pick + n])
                block = far[np.ix_(both, both)]
                expected = block[np.triu_indices(2 * n, 1)].mean()
                out.append(1 - far[pick, pick + n].mean() / expected if expected > 0 else 1.0)
            yield pd.DataFrame({"alpha": out})

    draws = spark.range(resamples).mapInPandas(alphas, "alpha double")
    return draws.agg(F.lit(n).cast("long").alias("n"), F.percentile("alpha", F.lit(0.025)).alias("lower"), F.percentile("alpha", F.lit(0.975)).alias("upper"))


def kappa_band(k: Column) -> Column:
    out = F.lit("poor")
    for least, name in reversed(KAPPA_BANDS):
        out = F.when(k >= least, name).otherwise(out)
    return F.when(k.isNotNull(), out)


def alpha_band(a: Column) -> Column:
    return F.when(a.isNotNull(), F.when(a >= 0.8, "reliable").when(a >= 0.667, "tentative").otherwise("unreliable"))
