"""Themes of entries: membership, prevalence, spread over contributors, and per-theme statistics.

Membership is a long table of pairs (std_id, theme); wide 0/1 columns exist only at the edges.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranges import quantiles, same, with_before
from ..functions.similarity import split_labels
from ..functions.text import metric_tag, truncated_at_word

# Score bands, prevalence bands, prefix of wide membership columns.
NEGATIVE, POSITIVE = -0.2, 0.2
HIGH, MEDIUM = 0.30, 0.10
PREFIX = "theme_membership_"
KIND_ORDER = ("framework", "emergent", "anomaly_bracket")


def cascade(entry_codes: DataFrame, theme_codes: DataFrame) -> DataFrame:
    """(std_id, theme, n_codes): entries take the themes of their codes.

    The code table is the small side; Spark sends it to all executors while it is under its
    broadcast threshold and shuffles by code otherwise.
    """
    return entry_codes.select("std_id", "code_key").distinct().join(theme_codes.select("code_key", "theme").distinct(), "code_key").groupBy("std_id", "theme").agg(F.count("*").alias("n_codes"))


def wide(entries: DataFrame, membership: DataFrame, themes: Sequence[str]) -> DataFrame:
    """``entries`` with a 0/1 column for each of the named themes; entries without themes have zeros."""
    flags = membership.where(F.col("theme").isin(*themes)).groupBy("std_id").pivot("theme", list(themes)).agg(F.lit(1))
    flags = flags.select("std_id", *(F.col(f"`{t}`").alias(f"{PREFIX}{t}") for t in themes))
    out = entries.join(flags, "std_id", "left")
    return out.withColumns({f"{PREFIX}{t}": F.coalesce(F.col(f"`{PREFIX}{t}`"), F.lit(0)) for t in themes})


def syntactic_names(names: Sequence[str]) -> list[str]:
    """Names of columns made of letters, digits, dots and underscores, the first not a digit; what would be one name twice is numbered."""
    out: list[str] = []
    for n in names:
        name = re.sub(r"[^\w.]", ".", n)
        name = name if re.match(r"[^\W\d_]|\.(?!\d)", name) else f"X{name}"
        same_ = [name, *(f"{name}.{i}" for i in range(1, len(names)))]
        out.append(next(m for m in same_ if m not in out))
    return out


def long(entries: DataFrame) -> DataFrame:
    """(std_id, theme) of wide 0/1 columns; null is no member."""
    columns = [c for c in entries.columns if c.startswith(PREFIX)]
    pairs = F.filter(F.array(*(F.struct(F.lit(c[len(PREFIX) :]).alias("theme"), F.col(f"`{c}`").cast("int").alias("member")) for c in columns)), lambda p: p["member"] == 1)
    return entries.select("std_id", F.explode(pairs).alias("p")).select("std_id", "p.theme")


def in_theme(cell: Column, theme: str) -> Column:
    """Whether a ``;``-joined cell has the theme as a whole label."""
    return F.array_contains(split_labels(cell), theme)


def joined_labels(membership: DataFrame) -> DataFrame:
    """(std_id, emerged_themes) with each entry's themes joined by ``"; "`` in order."""
    return membership.groupBy("std_id").agg(F.array_join(F.array_sort(F.collect_set("theme")), "; ").alias("emerged_themes"))


def prevalence_band(share: Column) -> Column:
    return F.when(share >= HIGH, "high").when(share >= MEDIUM, "medium").otherwise("low")


def tendency(mean: Column) -> Column:
    return F.when(mean.isNull(), "neutral").when(mean > POSITIVE, "positive").when(mean < NEGATIVE, "negative").otherwise("mixed")


def spread(rows: DataFrame, author: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_contributors, n_entries, top_share, gini) of entries over their contributors.

    Null and blank contributors are left out.  The Gini coefficient is null with one
    contributor.  It is taken from the histogram of entries per contributor, whose rows are
    few however many contributors there are, so no group is sorted in one task.
    """
    by = list(by)
    counts = rows.where(F.trim(F.col(author).cast("string")) != "").groupBy(*by, author).agg(F.count("*").alias("x"))
    bars = counts.groupBy(*by, "x").agg(F.count("*").alias("m"))
    below = F.coalesce(F.sum("m").over(W.partitionBy(*by or [F.lit(0)]).orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = bars.withColumn("ranks", F.col("m") * below + F.col("m") * (F.col("m") + 1) / 2)
    n, total = F.sum("m"), F.sum(F.col("m") * F.col("x"))
    gini = 2 * F.sum(F.col("ranks") * F.col("x")) / (n * total) - (n + 1) / n
    return ranked.groupBy(*by).agg(
        n.alias("n_contributors"),
        total.alias("n_entries"),
        (F.max("x") / total).alias("top_share"),
        F.when(n >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini))).alias("gini"),
    )


def spread_warning(of: DataFrame) -> DataFrame:
    """A row's warning: one contributor, or one with more than half of the entries."""
    return of.withColumn("warning", F.when(F.col("n_contributors") == 1, "single_contributor").when(F.col("top_share") > 0.5, "dominant_contributor"))


def label_counts(rows: DataFrame, labels: Column, of_labelled: bool = False) -> DataFrame:
    """(label, n, pct) of an array of labels; an entry counts once for each of its labels.

    pct is of all entries and may sum to over 100, or of the entries with labels.
    """
    found = rows.select(labels.alias("_l"))
    base = found.agg((F.count_if(F.size("_l") > 0) if of_labelled else F.count("*")).alias("_n"))
    counts = found.select(F.explode("_l").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(base)).select("label", "n", (100 * F.col("n") / F.col("_n")).alias("pct"))  # base is one row


def statistics(entries: DataFrame, membership: DataFrame, score: str, intensity: str | None = None) -> DataFrame:
    """One row a theme: n, pct_of_total, moments of the score, shares beyond the bands over all members.

    Shares are of the theme's entries, scored or not, and null where none has a score.
    """
    total = entries.agg(F.count("*").alias("_total"))
    kept = [score] + ([intensity] if intensity else [])
    rows = membership.select("std_id", "theme").distinct().join(entries.select("std_id", *kept), "std_id")
    s = F.col(score).try_cast("double")
    scored = F.count(s) > 0
    out = rows.groupBy("theme").agg(
        F.count("*").alias("n_entries"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("sd"),
        F.when(scored, 100 * F.count_if(s < NEGATIVE) / F.count("*")).alias("pct_negative"),
        F.when(scored, 100 * F.count_if(s > POSITIVE) / F.count("*")).alias("pct_positive"),
        *([F.avg(intensity).alias("intensity_mean"), F.stddev_samp(intensity).alias("intensity_sd")] if intensity else []),
    )
    middle = quantiles(rows.select("theme", s.alias("_x")), "_x", [0.5], ["theme"]).select("theme", F.col("_q")[0].alias("median"))
    out = same(out, middle, ["theme"])
    return out.crossJoin(F.broadcast(total)).withColumn("pct_of_total", 100 * F.col("n_entries") / F.col("_total")).drop("_total")


def enriched(entries: DataFrame, membership: DataFrame, score: str) -> DataFrame:
    """(theme, n_entries, share, prevalence, tendency), one row a theme."""
    stats = statistics(entries, membership, score)
    share = F.col("pct_of_total") / 100
    return stats.select("theme", "n_entries", share.alias("share"), prevalence_band(share).alias("prevalence"), tendency(F.col("mean")).alias("tendency"))


def keywords(theme_codes: DataFrame, frequencies: DataFrame, k: int = 8) -> DataFrame:
    """(theme, keywords): the ``k`` most frequent codes of each theme, ties by name."""
    ranked = theme_codes.select("theme", "code_key").distinct().join(frequencies, "code_key")
    place = F.row_number().over(W.partitionBy("theme").orderBy(F.desc("frequency"), "code_key"))
    return ranked.withColumn("place", place).where(F.col("place") <= k).groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code_key"))), lambda x: x["code_key"]).alias("keywords"))


def pruned(themes: DataFrame, counts: DataFrame) -> DataFrame:
    """``themes`` (theme_id, ...) with entries, numbered anew from 1 in order of their ids."""
    kept = themes.join(counts.where("n_entries > 0").select("theme_id"), "theme_id", "left_semi")
    return kept.withColumn("theme_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("theme_id")).cast(themes.schema["theme_id"].dataType))  # one row a theme


def display_order(kind: Column) -> Column:
    out = F.lit(len(KIND_ORDER))
    for i, k in reversed(list(enumerate(KIND_ORDER))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def boxes(rows: DataFrame, theme: str, score: str) -> DataFrame:
    """Quartiles and ends of the score by theme."""
    found = rows.where(F.col(score).isNotNull())
    ends = found.groupBy(theme).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"))
    return same(ends, quantiles(found, score, [0.25, 0.5, 0.75], [theme]), [theme]).select(theme, "n", "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high")


# --- quotes that stand for a theme ----------------------------------------------------------


def specific_entries(rows: DataFrame, least: int = 3) -> DataFrame:
    """Of each theme's rows (theme, breadth, ...) those no broader than the theme's median breadth, if ``least`` are left.

    breadth is the number of themes that an entry has.
    """
    wide_ = quantiles(rows.where("breadth > 0"), "breadth", [0.5], ["theme"]).select("theme", F.col("_q")[0].alias("_median"))
    marked = rows.join(wide_, "theme", "left").withColumn("_narrow", F.coalesce((F.col("breadth") > 0) & (F.col("breadth") <= F.col("_median")), F.lit(False)))
    enough = marked.groupBy("theme").agg((F.count_if("_narrow") >= least).alias("_enough"))
    return marked.join(enough, "theme").where("_narrow OR NOT _enough").drop("_median", "_narrow", "_enough")


def extreme_quotes(rows: DataFrame, score: str, order: str, least_chars: int = 50) -> DataFrame:
    """(theme, position, ...) of the most negative, median and most positive entry of each theme.

    Texts of ``least_chars`` characters or fewer don't count.  Equal scores are told apart by
    ``order``; null scores come last.  Of entries alike in both any one stands for them.  No
    theme is sorted: the ends are aggregates, the middle is found by sums over scores.
    """
    named = rows.where(F.char_length("std_text") > least_chars).withColumn("_s", F.coalesce(F.col(score).cast("double"), F.lit(float("inf"))))
    keys = named.select("theme", F.col(order).alias("_o"), "_s")
    ends = keys.groupBy("theme").agg(F.count("*").alias("_n"), F.min(F.struct("_s", "_o")).alias("_low"), F.max(F.struct("_s", "_o")).alias("_high"))
    # The score that holds the middle place, and of the entries with that score the one at the place left over.
    bars = with_before(keys.groupBy("theme", "_s").agg(F.count("*").alias("_k")), "_s", "_k", "_before", ["theme"]).join(ends.select("theme", F.ceil(F.col("_n") / 2).alias("_mid"), "_n"), "theme")
    bar = bars.where("_n >= 3 AND _before < _mid AND _mid <= _before + _k").select("theme", "_s", (F.col("_mid") - F.col("_before")).alias("_place"))
    ties = keys.join(bar, ["theme", "_s"]).withColumn("_one", F.lit(1))
    numeric = isinstance(rows.schema[order].dataType, T.NumericType)
    at = with_before(ties, "_o", "_one", "_i", ["theme"]) if numeric else ties.withColumn("_i", F.row_number().over(W.partitionBy("theme").orderBy("_o")) - 1)
    middle = at.where("_i + 1 = _place").select("theme", "_o", "_s", F.lit("median").alias("position"))
    outer = ends.select("theme", F.explode(F.array(*(F.struct(F.col(f"{c}._o").alias("_o"), F.col(f"{c}._s").alias("_s"), F.lit(p).alias("position"), F.lit(n).alias("_least")) for c, p, n in (("_low", "most_negative", 1), ("_high", "most_positive", 2))))).alias("e"), "_n")
    chosen = outer.where("_n >= e._least").select("theme", "e._o", "e._s", "e.position").unionByName(middle).withColumnsRenamed({"theme": "_theme", "_s": "_score"})
    found = named.join(chosen, (F.col("theme") == F.col("_theme")) & (F.col(order) == F.col("_o")) & (F.col("_s") == F.col("_score")))
    return found.dropDuplicates(["theme", "position"]).drop("_theme", "_o", "_s", "_score")


def spread_quotes(rows: DataFrame, score: str, order: str, author: str, least_chars: int = 50) -> DataFrame:
    """As :func:`extreme_quotes`, but preferring an author not yet quoted.

    From the target position the nearest entry of such an author is taken, however far, the
    lower one first at each distance; the target itself is taken if none will do.  An
    aggregate by theme and author gives each author's nearest entry to each target; an entry
    without author stands by itself.  Two authors at most are quoted before, so the three
    nearest of a target are enough.
    """
    place = W.partitionBy("theme").orderBy(F.col(score).asc_nulls_last(), order)
    ranked = rows.where(F.char_length("std_text") > least_chars).withColumn("_i", F.row_number().over(place)).withColumn("_n", F.count("*").over(W.partitionBy("theme")))
    named = F.nullif(F.col(author).cast("string"), F.lit(""))
    ranked = ranked.select("theme", F.col("std_id").cast("string").alias("std_id"), F.col(author).cast("string").alias("author"), F.col(score).cast("double").alias("score"), "_i", "_n", F.when(named.isNull(), F.col("_i")).alias("_alone"))
    targets = {"most_negative": F.lit(1), "median": F.ceil(F.col("_n") / 2), "most_positive": F.col("_n")}
    nearest = [F.min(F.struct(F.abs(F.col("_i") - t).alias("far"), F.col("_i").alias("place"), "std_id", "score")).alias(label) for label, t in targets.items()]
    by = ranked.groupBy("theme", "author", "_alone").agg(F.max("_n").alias("_n"), *nearest)
    long = by.select("theme", "author", "_alone", "_n", F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.col(k).alias("at")) for k in targets))).alias("t"))
    near = long.select("theme", "t.position", "t.at.*", "author", "_alone", "_n")
    first = F.row_number().over(W.partitionBy("theme", "position").orderBy("far", "place"))
    near = near.withColumn("_first", first).where(F.col("_first") <= len(targets))
    schema = "theme string, position string, std_id string, author string, score double, place int"

    def pick(pdf):
        import pandas as pd

        n, taken, authors, out = int(pdf["_n"].iloc[0]), set(), set(), []
        for label in ["most_negative"] + ["median"] * (n >= 3) + ["most_positive"] * (n >= 2):
            ring = pdf[pdf["position"] == label].sort_values("_first").to_dict("records")
            at = next((r for r in ring if r["place"] not in taken and r["author"] not in authors), ring[0])
            taken.add(at["place"])
            if at["author"]:
                authors.add(at["author"])
            out.append((at["theme"], label, at["std_id"], at["author"], at["score"], at["place"]))
        return pd.DataFrame(out, columns=["theme", "position", "std_id", "author", "score", "place"])

    return near.groupBy("theme").applyInPandas(pick, schema)


def tagged_quotes(rows: DataFrame, score: str, order: str, metrics: Sequence[str], most: int = 280) -> DataFrame:
    """(theme, position, std_id, quote): extreme quotes cut at a word, with a tag of their metrics."""
    text = F.concat_ws(" ", truncated_at_word(F.col("std_text"), most), F.nullif(metric_tag(metrics), F.lit("")))
    return extreme_quotes(rows, score, order).select("theme", "position", "std_id", text.alias("quote"))


def theme_set_summary(themes: DataFrame, top: int = 5) -> DataFrame:
    """(kind, n_themes, top): how many themes of each kind (theme, kind, n_entries), and the largest."""
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n_entries"), "theme"))
    ranked = themes.withColumn("_i", place)
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("_i") <= top, F.struct("_i", "theme")))), lambda x: x["theme"])
    return ranked.groupBy("kind").agg(F.count("*").alias("n_themes"), best.alias("top"))


def frequent_labels(membership: DataFrame, top: int = 30) -> DataFrame:
    return membership.groupBy("theme").agg(F.countDistinct("std_id").alias("n")).orderBy(F.desc("n"), "theme").limit(top)
