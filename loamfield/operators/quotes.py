"""Quotes and whether their sources say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_quote, quote_id, text_digest

# Scores of the steps, and the least cosine of a paraphrase.
EXACT, NORMALISED, FOUND, LEAST_COSINE = 1.0, 0.95, 0.85, 0.85


def made(rows: DataFrame, doc: str, text: str, start: str, end: str, quote: str) -> DataFrame:
    """``rows`` with quote_id and source_sha256; offsets count characters from 0, the end is outside."""
    return rows.withColumns({"quote_id": quote_id(F.col(doc), F.col(start), F.col(end), F.col(quote)), "source_sha256": text_digest(F.col(text))})


def verified(rows: DataFrame, source: str = "source_text", quote: str = "exact_text", start: str = "start_char", end: str = "end_char", digest: str = "source_sha256", cosine: str | None = None) -> DataFrame:
    """``rows`` with status, method, score and failure_reason of each quote.

    The steps: the same characters at the offsets; the same after normalisation there; the
    normalised quote anywhere in the source; and where a cosine is given, one of 0.85 or
    more.  What fails all is drifted if the source changed since, else fabricated, with the
    deepest step that failed.  A missing source makes a quote drifted.
    """
    s, q = F.col(source), F.col(quote)
    inside = F.col(end) <= F.char_length(s)
    there = F.substring(s, F.col(start) + 1, F.col(end) - F.col(start))
    target = normalise_quote(q)
    exact = inside & (there == q)
    near = inside & (normalise_quote(there) == target)
    anywhere = (target != "") & normalise_quote(s).contains(target)
    alike = F.coalesce(F.col(cosine) >= LEAST_COSINE, F.lit(False)) if cosine else F.lit(False)
    step = F.when(exact, 1).when(near, 2).when(anywhere, 3).when(alike, 4)
    drifted = text_digest(s) != F.col(digest)
    reason = F.when(F.col(cosine).isNull(), "step4_embedding_unavailable").otherwise("step4_embedding_below_threshold") if cosine else F.when(target == "", "step3_target_empty_after_normalization").otherwise("step3_substring_not_found")
    k = F.col("_step")
    return rows.withColumn("_step", step).withColumns(
        {
            "status": F.when(s.isNull(), "drifted").when(k == 1, "verified_exact").when(k.isNotNull(), "verified_fuzzy").when(drifted, "drifted").otherwise("fabricated"),
            "method": F.when(s.isNotNull() & k.isNotNull(), F.element_at(F.array(*map(F.lit, ("string_match", "normalized_match", "substring_search", "embedding_cosine"))), k)),
            "score": F.when(s.isNotNull(), F.when(k == 1, EXACT).when(k == 2, NORMALISED).when(k == 3, FOUND).when(k == 4, F.col(cosine) if cosine else F.lit(None))),
            "failure_reason": F.when(s.isNull(), "source_missing_from_corpus").when(k.isNull(), F.when(drifted, "source_text_sha256_mismatch").otherwise(reason)),
        }
    ).drop("_step")


def against_corpus(quotes: DataFrame, entries: DataFrame, key: str = "std_id", text: str = "std_text") -> DataFrame:
    """Quotes (key, ...) verified against the texts of their entries; quotes of unknown entries are drifted."""
    return verified(quotes.join(entries.select(key, F.col(text).alias("source_text")), key, "left"))


def excerpt_found(excerpt: Column, text: Column) -> Column:
    """Whether an excerpt of five characters or more stands in a text, white space and case apart."""
    squeezed = [F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) for c in (excerpt, text)]
    return (F.char_length(squeezed[0]) >= 5) & squeezed[1].contains(squeezed[0])


def provenance(quotes: DataFrame) -> DataFrame:
    """(kind, key, n, n_verified) by status, method and citation source, from one pass with grouping sets."""
    ok = F.col("status").isin("verified_exact", "verified_fuzzy")
    counts = quotes.groupingSets([[F.col("status")], [F.col("method")], [F.col("citation_source")]], "status", "method", "citation_source").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_verified"), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "status").when(F.col("_g") == 5, "method").otherwise("citation_source")
    return counts.select(kind.alias("kind"), F.coalesce("status", "method", "citation_source").alias("key"), "n", "n_verified").where("key IS NOT NULL")


def provenance_rates(quotes: DataFrame) -> DataFrame:
    n = F.count("*")
    return quotes.agg(
        n.alias("total"),
        F.try_divide(F.count_if(F.col("status").isin("verified_exact", "verified_fuzzy")), n).alias("verification_rate"),
        F.try_divide(F.count_if(F.col("status") == "fabricated"), n).alias("fabrication_rate"),
        F.try_divide(F.count_if(F.col("status") == "drifted"), n).alias("drift_rate"),
    )


def located(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Offsets of a quote, resolved anew by its first occurrence where they are stale; null where it isn't found."""
    fits = F.substring(text, start + 1, end - start) == quote
    at = F.instr(text, quote) - 1
    return F.when(fits, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).when(at >= 0, F.struct(at.cast("int").alias("start"), (at + F.char_length(quote)).cast("int").alias("end")))
