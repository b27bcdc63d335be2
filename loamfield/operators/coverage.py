"""What of a corpus was looked at, what was skipped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count

# Classes of skip reasons and their patterns, the first match counts.
SKIP_CLASSES = (
    ("AI call failure (network / API / parse)", r"^ai response parse failure$"),
    (
        "Media-only (image / video / GIF / emoji)",
        r"\b(gif|emoji|sticker|emoticon|image|images|photo|video|videos|media[ -]?only|attachment|attachments|reaction[- ]?image)\b",
    ),
    ("Duplicate / near-duplicate", r"\b(duplicate|reposted|repost|already (covered|posted|discussed)|same as|identical|previously (mentioned|posted))\b"),
    (
        "Metadata / tag / link only",
        r"(\bsubreddit (tag|reference|mention)|/r/|\btag(s|ged)? only|\blink(s)?( only)?\b|\burl(s)?( only)?\b|\bmention(s)? only|\bmetadata\b|^@\S+\s*$)",
    ),
    ("Quote / reply with no original content", r"(\bquote (only|of)\b|\bquoting\b|\breply (to|that has)\b|just a (reply|response|quote)|paraphrase of|forwarded)"),
    (
        "Question without contributable content",
        r"(\bonly a question\b|\bquestion without\b|\bjust asking\b|\basking for (help|advice|info|information|opinions)|\bwondering (if|how|when|what|where|why)|\bseeking (advice|help|info|input))",
    ),
    (
        "Too short / no substantive content",
        r"(\btoo short\b|\binsufficient (content|text|detail|context)|\bno (substantive|meaningful|relevant|usable) content|\b(empty|blank) (entry|post|comment)|\bstub\b|\bfewer than\b|\bless than [0-9]|\bbrief (comment|reply)|\bone[- ](word|liner)|\bvery brief\b)",
    ),
    (
        "Off-topic / not about research focus",
        r"(\boff[ -]?topic\b|\bnot (about|related|relevant|on[- ]?topic)|\bunrelated\b|\birrelevant\b|\bdoes not (relate|pertain|concern|address|discuss|mention|involve|cover)|\boutside (the )?(scope|topic|focus|study)|\bdoesn'?t (relate|discuss|mention|address)|\bnot pertinent\b|\bno (?:relevant )?information about\b)",
    ),
)
OTHER = "Other / unspecified"


def skip_class(reason: Column) -> Column:
    text = F.lower(F.when(F.coalesce(reason, F.lit("")) == "", "(unspecified)").otherwise(reason))
    out = F.lit(OTHER)
    for label, pattern in reversed(SKIP_CLASSES):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def skip_classes(reasons: DataFrame, reason: str = "reason") -> DataFrame:
    """(label, n, n_distinct, examples): classes of reasons with up to three examples, the most frequent first."""
    text = F.when(F.coalesce(F.col(reason), F.lit("")) == "", "(unspecified)").otherwise(F.col(reason))
    counts = reasons.groupBy(text.alias("reason")).agg(F.count("*").alias("k")).withColumn("label", skip_class(F.col("reason")))
    ranked = counts.withColumn("_i", F.row_number().over(W.partitionBy("label").orderBy(F.desc("k"), "reason")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("_i") <= 3, F.struct("_i", "reason")))), lambda x: x["reason"])
    return ranked.groupBy("label").agg(F.sum("k").alias("n"), F.count("*").alias("n_distinct"), top.alias("examples"))


def reported_order(classes: DataFrame) -> DataFrame:
    return classes.orderBy((F.col("label") == OTHER).cast("int"), F.desc("n"), "label")


def coverage(entries: DataFrame, results: DataFrame, codes: DataFrame, stopped_at: int | None = None) -> DataFrame:
    """One row: how the entries (std_id, std_text) part into processed, skipped, coded and examined without codes.

    ``results`` has (std_id, skipped, and where tracked chars_sent, truncated), ``codes`` the
    pairs (std_id, code_key).  Truncation is reported only if every matched result tracks it.
    ``stopped_at`` is the entry at which coding stopped on purpose: exactly the entries after
    it may then be unprocessed.  Repeated ids make the figures void: n_duplicate_ids says so.
    """
    coded = codes.where("code_key <> ''").select("std_id").distinct().withColumn("_coded", F.lit(True))
    tracked = "chars_sent" in results.columns and "truncated" in results.columns
    kept = results.select("std_id", F.coalesce("skipped", F.lit(False)).alias("_skipped"), *(["chars_sent", "truncated"] if tracked else []))
    rows = entries.join(kept, "std_id", "left").join(coded, "std_id", "left")
    seen, skipped, has = F.col("_skipped").isNotNull(), F.coalesce("_skipped", F.lit(False)), F.coalesce("_coded", F.lit(False))
    all_tracked = F.count_if(seen & F.col("chars_sent").isNotNull() & F.col("truncated").isNotNull()) == F.count_if(seen) if tracked else F.lit(False)
    out = rows.agg(
        F.count("*").alias("n_input"),
        (F.count("*") - F.countDistinct("std_id")).alias("n_duplicate_ids"),
        F.count_if(seen).alias("n_processed"),
        F.count_if(~seen).alias("n_unprocessed"),
        F.count_if(skipped).alias("n_skipped"),
        F.count_if(seen & ~skipped & has).alias("n_coded"),
        F.count_if(seen & ~skipped & ~has).alias("n_examined_no_codes"),
        F.coalesce(F.sum(F.when(seen, F.octet_length("std_text"))), F.lit(0)).alias("bytes_processed"),
        F.coalesce(F.sum(F.when(seen, F.char_length("std_text"))), F.lit(0)).alias("chars_processed"),
        F.coalesce(F.sum(F.when(seen, word_count(F.col("std_text")))), F.lit(0)).alias("words_processed"),
        all_tracked.alias("truncation_tracked"),
        *([F.when(all_tracked, F.count_if("truncated")).alias("n_entries_truncated"), F.when(all_tracked, F.sum("chars_sent")).alias("chars_sent")] if tracked else []),
    )
    expected = F.greatest(F.lit(0), F.col("n_input") - stopped_at) if stopped_at is not None else F.lit(0)
    return out.withColumns(
        {
            "coverage_rate": F.when(F.col("n_input") > 0, F.col("n_processed") / F.col("n_input")),
            "no_silent_truncation": (F.col("n_unprocessed") == expected) & (F.col("n_input") > 0),
        }
    )


def attempt_grid(themes: DataFrame, categories: list[str], attempts: DataFrame, skips: DataFrame) -> DataFrame:
    """(theme, category, n_attempts, n_emitted, skipped, status) for every theme and category.

    Status is covered, explicit_skip or silent_skip; themes and categories are both small.
    """
    spark = themes.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("category"))
    tried = attempts.groupBy("theme", "category").agg(F.count("*").alias("n_attempts"), F.sum("n_emitted").alias("n_emitted"))
    left = skips.select("theme", "category").distinct().withColumn("skipped", F.lit(True))
    grid = themes.select("theme").distinct().crossJoin(F.broadcast(listed))
    rows = grid.join(tried, ["theme", "category"], "left").join(left, ["theme", "category"], "left")
    n = F.coalesce("n_attempts", F.lit(0)).cast("long")
    skipped = F.coalesce("skipped", F.lit(False))
    status = F.when(n > 0, "covered").when(skipped, "explicit_skip").otherwise("silent_skip")
    return rows.select("theme", "category", n.alias("n_attempts"), F.coalesce("n_emitted", F.lit(0)).cast("long").alias("n_emitted"), skipped.alias("skipped"), status.alias("status"))


def audit_summary(log: DataFrame) -> DataFrame:
    """(kind, key, n, tokens): counts of an audit log (step, decision_type, model, tokens) by type, step and model."""
    long = log.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in (("type", "decision_type"), ("step", "step"), ("model", "model"))))).alias("p"), "tokens")
    return long.where("p.key IS NOT NULL").groupBy("p.kind", "p.key").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def cumulative_codes(births: DataFrame, day: str) -> DataFrame:
    """(day, n_new, n_codes) of codes by the day they came up: days first, then a running sum over few rows."""
    daily = births.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n_new"))
    return daily.withColumn("n_codes", F.sum("n_new").over(W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
