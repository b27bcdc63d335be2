"""Queries on loading, cleaning, themes, coverage and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import coding, coverage, preprocess, quotes, themes
from ..sources import ingest
from .registry import query, table

_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows" for t in _ALL))
def explore_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.explored(spark, {t: table(spark, sf_dir, t) for t in _ALL}).select("table_name", "n_rows")


@query("SELECT source_table, count(*) AS n, count(n_chars) AS n_with_chars, count(turn) AS n_with_turn FROM (SELECT 'documents' AS source_table, doc_id::VARCHAR AS std_id, n_chars, NULL AS turn FROM documents UNION ALL SELECT 'conversations', conv_id || '-' || turn, NULL, turn FROM conversations) GROUP BY 1")
def combine_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns as one corpus, metrics that a table lacks null."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    parts = {
        "documents": ingest.standardised(docs, ingest.detected_columns(docs.columns)),
        "conversations": ingest.standardised(turns.drop("conv_id"), {"id": "id", "text": "text", "author": "role", "timestamp": None}),
    }
    return ingest.combined(parts).groupBy("source_table").agg(F.count("*").alias("n"), F.count("n_chars").alias("n_with_chars"), F.count("turn").alias("n_with_turn"))


@query("SELECT 'turns:' || conv_id AS std_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.prefixed(table(spark, sf_dir, "conversations").withColumn("t", F.lit("turns")), "t", "conv_id")
    return ingest.repeated(rows, "conv_id").withColumnRenamed("conv_id", "std_id")


_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_ENTITIES = "replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


def _sub(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, to in pairs:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_NO_URL = _sub("std_text", (r"https?://[^\s)>]+", ""), (r"www\.\S+", ""))


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_REDDIT = _sub(_ENTITIES.format(x=_sub(_NO_URL, (f"u/{_W}+", ""), (f"r/{_W}+", "[subreddit]"), (f"@{_W}+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), ("~~([^~]+)~~", r"\1"), (r"(?m)^&gt;.*$", ""))), (r"\[removed\]", ""), (r"\[deleted\]", ""))
_TWITTER = _ENTITIES.format(x=_sub(_NO_URL, (f"@{_W}+", ""), (r"^RT\s+", "")))
_CLINICAL = _ENTITIES.format(x=_sub(_NO_URL, (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"), (r"\b(MRN|DOB|SSN)\s*:\s*\S+", "[REDACTED]")))
_GENERIC = _ENTITIES.format(x=_sub(_NO_URL, (f"@{_W}+", "")))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("std_id"), F.col("text").alias("std_text"), F.col("doc_id").alias("row_ord"), "lang", "source", "n_chars")


def _cleaned(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = text.with_clean(_entries(spark, sf_dir), "std_text", text.CleaningRules(source_type=kind))
    return rows.select("std_id", text.text_digest(F.col("std_text")).alias("sha"))


_CLEANED = "SELECT doc_id AS std_id, sha256(nfc_normalize({x})) AS sha FROM (SELECT doc_id, text AS std_text FROM documents)"


@query(_CLEANED.format(x=_squeezed(_REDDIT)))
def clean_platform_reddit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "reddit")


@query(_CLEANED.format(x=_squeezed(_TWITTER)))
def clean_platform_twitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "twitter")


@query(_CLEANED.format(x=_squeezed(_CLINICAL)))
def clean_platform_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "clinical")


@query(_CLEANED.format(x=_squeezed(_GENERIC)))
def clean_platform_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "generic")


@query(f"""
WITH c AS (SELECT doc_id AS std_id, nfc_normalize({_squeezed(_GENERIC)}) AS t FROM (SELECT doc_id, text AS std_text FROM documents) WHERE trim(std_text) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY std_id) AS i FROM c WHERE length(t) BETWEEN 10 AND 10000)
SELECT std_id, length(t)::INT AS chars, sha256(t) AS sha FROM k WHERE i = 1
""")
def clean_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned entries of a length within bounds, the first of each text."""
    out = preprocess.preprocessed(_entries(spark, sf_dir), text.CleaningRules(source_type="generic"))
    return out.select("std_id", F.char_length("std_text").alias("chars"), text.text_digest(F.col("std_text")).alias("sha"))


@query(f"SELECT page_id, sha256({_ENTITIES.format(x='html')}) AS sha FROM pages")
def clean_html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.text_digest(text.decode_entities(F.col("html"))).alias("sha"))


@query("SELECT lang, count(*) AS n FROM documents WHERE length(text) BETWEEN 10 AND 10000 GROUP BY lang")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.char_length("text").between(10, 10000)).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, ceil(length(text) / 4)::INT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END::INT AS words, strlen(text)::INT AS bytes FROM documents".replace("\\\\", "\\"))
def word_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"))


@query("""
SELECT p_partkey, CASE WHEN length(n) <= 12 THEN n ELSE substr(n, 1, 9) || '...' END AS short, regexp_replace(lower(trim(n)), '[^a-z0-9]+', '_', 'g') AS slug,
       sha1(p_partkey || '|0|3|' || substr(n, 1, 3)) AS quote FROM (SELECT p_partkey, p_name AS n FROM part)
""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    quote = F.substring(text.quote_id(F.col("p_partkey"), F.lit(0), F.lit(3), F.substring(name, 1, 3)), 5, 40)
    return table(spark, sf_dir, "part").select("p_partkey", text.truncated(name, 12).alias("short"), text.code_slug(name).alias("slug"), quote.alias("quote"))


# --- themes ---------------------------------------------------------------------------------

_CODES = [("rights", "(?i)rights"), ("license", "(?i)licen[sc]e"), ("the", r"\bthe\b"), ("die", r"\bdie\b"), ("les", r"\bles\b"), ("numbers", "[0-9]+")]
_THEMES = {"rights": "legal", "license": "legal", "the": "english", "die": "german", "les": "french", "numbers": "figures"}
_SEGMENTS = "s AS (SELECT doc_id AS std_id, k AS code_key, regexp_extract(text, p) AS t FROM documents, (VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in _CODES) + ") r(k, p) WHERE length(text) >= 10 AND regexp_matches(text, p))"
_MEMBERS = f"{_SEGMENTS}, m AS (SELECT std_id, CASE code_key " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _THEMES.items()) + " END AS theme, count(*) AS n_codes FROM s GROUP BY ALL)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.pattern_segments(_entries(spark, sf_dir), _CODES)


def _theme_codes(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for p in _THEMES.items() for x in p))).alias("code_key", "theme"))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.cascade(_segments(spark, sf_dir), _theme_codes(spark))


@query(f"WITH {_SEGMENTS} SELECT code_key, count(*) AS frequency, count(DISTINCT std_id) AS n_entries FROM s GROUP BY 1")
def codebook_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.codebook(_segments(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT s.std_id, code_key, strpos(text, t)::INT - 1 AS start_char, (strpos(text, t) - 1 + length(t))::INT AS end_char, t AS text FROM s JOIN documents ON doc_id = std_id".replace("s.std_id, code_key", "s.std_id, code_key"))
def coded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.placed_segments(_segments(spark, sf_dir), _entries(spark, sf_dir))


@query(f"WITH {_MEMBERS} SELECT * FROM m")
def cascade_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _membership(spark, sf_dir)


@query(f"WITH {_MEMBERS} SELECT doc_id AS std_id, coalesce(max((theme = 'legal')::INT), 0)::INT AS theme_membership_legal, coalesce(max((theme = 'english')::INT), 0)::INT AS theme_membership_english FROM documents LEFT JOIN m ON doc_id = std_id GROUP BY doc_id")
def membership_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.wide(_entries(spark, sf_dir).select("std_id"), _membership(spark, sf_dir), ["legal", "english"])


@query(f"WITH {_MEMBERS} SELECT std_id, string_agg(DISTINCT theme, '; ' ORDER BY theme) AS emerged_themes FROM m GROUP BY 1")
def joined_theme_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.joined_labels(_membership(spark, sf_dir))


_SCORE = "((n_chars % 2001) - 1000) / 1000.0"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).withColumn("sentiment_score", ((F.col("n_chars") % 2001) - 1000) / 1000.0)


@query(f"""
WITH {_MEMBERS}, e AS (SELECT theme, ({_SCORE})::DOUBLE AS s FROM m JOIN documents ON doc_id = std_id)
SELECT theme, count(*) AS n_entries, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(quantile_cont(s, 0.5), 6) AS median, round(100 * count(*) FILTER (s < -0.2) / count(*), 6) AS pct_negative,
       round(100 * count(*) FILTER (s > 0.2) / count(*), 6) AS pct_positive, round(100 * count(*) / (SELECT count(*) FROM documents), 6) AS pct_of_total FROM e GROUP BY theme
""")
def theme_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.statistics(_scored(spark, sf_dir), _membership(spark, sf_dir), "sentiment_score")
    return out.select("theme", "n_entries", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "pct_negative", "pct_positive", "pct_of_total")))


@query(f"""
WITH {_MEMBERS}, e AS (SELECT theme, count(*) AS n_entries, count(*) / (SELECT count(*) FROM documents) AS share, avg({_SCORE}) AS a FROM m JOIN documents ON doc_id = std_id GROUP BY theme)
SELECT theme, n_entries, CASE WHEN share >= 0.3 THEN 'high' WHEN share >= 0.1 THEN 'medium' ELSE 'low' END AS prevalence, CASE WHEN a IS NULL THEN 'neutral' WHEN a > 0.2 THEN 'positive' WHEN a < -0.2 THEN 'negative' ELSE 'mixed' END AS tendency FROM e
""")
def theme_prevalence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.enriched(_scored(spark, sf_dir), _membership(spark, sf_dir), "sentiment_score").drop("share")


@query(f"""
WITH {_SEGMENTS}, f AS (SELECT code_key, count(*) AS n FROM s GROUP BY 1), t AS (SELECT code_key, CASE code_key {" ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _THEMES.items())} END AS theme, n FROM f)
SELECT theme, list(code_key ORDER BY n DESC, code_key) AS keywords FROM t GROUP BY theme
""")
def theme_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.keywords(_theme_codes(spark), coding.codebook(_segments(spark, sf_dir)).select("code_key", "frequency"))


@query("""
WITH q AS (SELECT l_returnflag AS theme, l_linestatus AS subtheme, median(l_quantity::DOUBLE) AS med, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, count(*) AS n, 1.4826 * mad(l_quantity::DOUBLE) AS mad FROM lineitem GROUP BY ALL)
SELECT theme, subtheme, n AS n_observed, round(med, 6) AS median, round(mad, 6) AS mad, round(mean, 6) AS mean, round(sd, 6) AS sd FROM q
""")
def subtheme_metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.metrics import described_values

    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "theme", "l_linestatus": "subtheme"})
    out = described_values(rows, "l_quantity", ["median", "mad", "mean", "sd"], ["theme", "subtheme"])
    return out.select("theme", "subtheme", "n_observed", *(F.round(c, 6).alias(c) for c in ("median", "mad", "mean", "sd")))


@query("""
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS l FROM documents), e AS (SELECT unnest(l) AS label FROM w)
SELECT label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM w), 6) AS pct FROM e GROUP BY 1
""")
def multilabel_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of entries counted once each; shares are of all entries."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    out = themes.label_counts(table(spark, sf_dir, "documents"), words)
    return out.withColumn("pct", F.round("pct", 6))


@query("SELECT source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def overall_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("_n"))
    by = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))
    return by.crossJoin(F.broadcast(total)).select("source", "n", F.round(100 * F.col("n") / F.col("_n"), 6).alias("pct"), "chars", "langs")


@query("SELECT lang AS theme, count(*) AS n, min(n_chars)::BIGINT AS low, round(quantile_cont(n_chars, 0.25), 4) AS q1, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.75), 4) AS q3, max(n_chars)::BIGINT AS high FROM documents GROUP BY lang")
def score_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.boxes(table(spark, sf_dir, "documents").withColumnRenamed("lang", "theme"), "theme", "n_chars")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


_QUOTED = f"""
WITH {_MEMBERS}, e AS (SELECT theme, std_id, {_SCORE} AS s FROM m JOIN documents ON doc_id = std_id WHERE length(text) > 50),
r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY s, std_id) AS i, count(*) OVER (PARTITION BY theme) AS n FROM e)
SELECT theme, std_id, CASE WHEN i = 1 THEN 'most_negative' WHEN n >= 3 AND i = ceil(n / 2) THEN 'median' ELSE 'most_positive' END AS position FROM r WHERE i = 1 OR (n >= 3 AND i = ceil(n / 2)) OR (n >= 2 AND i = n)
"""


def _theme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _membership(spark, sf_dir).join(_scored(spark, sf_dir), "std_id")


@query(_QUOTED)
def representative_quotes_minmedmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.extreme_quotes(_theme_rows(spark, sf_dir), "sentiment_score", "std_id").select("theme", "std_id", "position")


def _nearest(target: str, taken: list[str]) -> str:
    """SQL of the place nearest to a target whose entry and author aren't taken yet, else the target."""
    free = " AND ".join(f"e.i <> {t}.i AND (coalesce(e.a, '') = '' OR e.a IS DISTINCT FROM {t}.a)" for t in taken)
    return f"coalesce(min({{'far': abs(e.i - {target}), 'i': e.i}}) FILTER ({free}).i, {target})"


@query(f"""
WITH {_MEMBERS}, f AS (SELECT theme, std_id, source AS a, ({_SCORE})::DOUBLE AS s FROM m JOIN documents ON doc_id = std_id WHERE length(text) > 50),
e AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY s, std_id) AS i, count(*) OVER (PARTITION BY theme) AS n FROM f), p1 AS (SELECT * FROM e WHERE i = 1),
q2 AS (SELECT e.theme, {_nearest("any_value(ceil(e.n / 2))::BIGINT", ["p1"])} AS i FROM e JOIN p1 USING (theme) WHERE e.n >= 3 GROUP BY e.theme), p2 AS (SELECT e.* FROM e JOIN q2 USING (theme, i)),
b AS (SELECT p1.theme, p1.i AS i1, p1.a AS a1, coalesce(p2.i, 0) AS i2, p2.a AS a2 FROM p1 LEFT JOIN p2 USING (theme)), x AS (SELECT theme, i1 AS i, a1 AS a FROM b), y AS (SELECT theme, i2 AS i, a2 AS a FROM b),
q3 AS (SELECT e.theme, {_nearest("any_value(e.n)", ["x", "y"])} AS i FROM e JOIN x ON x.theme = e.theme JOIN y ON y.theme = e.theme WHERE e.n >= 2 GROUP BY e.theme), p3 AS (SELECT e.* FROM e JOIN q3 USING (theme, i)),
z AS (SELECT *, 'most_negative' AS position FROM p1 UNION ALL SELECT *, 'median' FROM p2 UNION ALL SELECT *, 'most_positive' FROM p3)
SELECT theme, position, std_id::VARCHAR AS std_id, a AS author, round(s, 9) AS score, i::INT AS place FROM z
""".replace("abs(e.i - any_value(ceil(e.n / 2))::BIGINT)", "abs(e.i - ceil(e.n / 2)::BIGINT)").replace("abs(e.i - any_value(e.n))", "abs(e.i - e.n)"))
def spread_aware_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, from different sources where there are some."""
    return themes.spread_quotes(_theme_rows(spark, sf_dir), "sentiment_score", "std_id", "source").withColumn("score", F.round("score", 9))


# --- coverage, provenance -------------------------------------------------------------------


@query("""
WITH r AS (SELECT doc_id, toxic = 1 AS skipped, quality = 1 AS coded FROM labels)
SELECT count(*) AS n_input, (count(*) - count(DISTINCT d.doc_id)) AS n_duplicate_ids, count(r.doc_id) AS n_processed, count(*) FILTER (r.doc_id IS NULL) AS n_unprocessed, count(*) FILTER (skipped) AS n_skipped,
       count(*) FILTER (NOT skipped AND coded) AS n_coded, count(*) FILTER (NOT skipped AND NOT coded) AS n_examined_no_codes, sum(strlen(text)) FILTER (r.doc_id IS NOT NULL)::BIGINT AS bytes_processed,
       sum(length(text)) FILTER (r.doc_id IS NOT NULL)::BIGINT AS chars_processed, round(count(r.doc_id) / count(*), 6) AS coverage_rate, false AS no_silent_truncation FROM documents d LEFT JOIN r USING (doc_id)
""")
def coverage_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    results = labels.select(F.col("doc_id").alias("std_id"), (F.col("toxic") == 1).alias("skipped"))
    codes = labels.where("quality = 1").select(F.col("doc_id").alias("std_id"), F.lit("good").alias("code_key"))
    out = coverage.coverage(_entries(spark, sf_dir), results, codes)
    return out.withColumn("coverage_rate", F.round("coverage_rate", 6)).drop("words_processed", "truncation_tracked")


@query("""
WITH r AS (SELECT CASE event_id % 6 WHEN 0 THEN 'Duplicate of ' || user_id % 5 WHEN 1 THEN 'off-topic' WHEN 2 THEN 'too short' WHEN 3 THEN 'image only' WHEN 4 THEN '' ELSE 'misc ' || user_id % 3 END AS r FROM events),
c AS (SELECT CASE WHEN r = '' THEN '(unspecified)' ELSE r END AS reason, count(*) AS k FROM r GROUP BY 1),
l AS (SELECT *, CASE WHEN reason ILIKE 'image%' THEN 'Media-only (image / video / GIF / emoji)' WHEN reason ILIKE 'duplicate%' THEN 'Duplicate / near-duplicate' WHEN reason = 'too short' THEN 'Too short / no substantive content'
      WHEN reason = 'off-topic' THEN 'Off-topic / not about research focus' ELSE 'Other / unspecified' END AS label FROM c)
SELECT label, sum(k)::BIGINT AS n, count(*) AS n_distinct, (list(reason ORDER BY k DESC, reason))[1:3] AS examples FROM l GROUP BY label
""")
def skip_reason_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 6, F.col("user_id")
    reason = F.when(k == 0, F.concat(F.lit("Duplicate of "), (u % 5).cast("string"))).when(k == 1, "off-topic").when(k == 2, "too short").when(k == 3, "image only").when(k == 4, "").otherwise(F.concat(F.lit("misc "), (u % 3).cast("string")))
    return coverage.skip_classes(table(spark, sf_dir, "events").select(reason.alias("reason")))


@query("""
WITH t AS (SELECT DISTINCT r_name AS theme FROM region), c AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '6-NONE']) AS category),
a AS (SELECT r_name AS theme, o_orderpriority AS category, count(*) AS n_attempts, sum(o_custkey % 3)::BIGINT AS n_emitted FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT t.theme, c.category, coalesce(n_attempts, 0)::BIGINT AS n_attempts, coalesce(n_emitted, 0)::BIGINT AS n_emitted, t.theme = 'ASIA' AND c.category = '6-NONE' AS skipped,
       CASE WHEN n_attempts > 0 THEN 'covered' WHEN t.theme = 'ASIA' AND c.category = '6-NONE' THEN 'explicit_skip' ELSE 'silent_skip' END AS status
FROM t CROSS JOIN c LEFT JOIN a ON a.theme = t.theme AND a.category = c.category
""")
def skip_grid_mode1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    attempts = joined.select(F.col("r_name").alias("theme"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 3).alias("n_emitted"))
    skips = region.where("r_name = 'ASIA'").select(F.col("r_name").alias("theme"), F.lit("6-NONE").alias("category"))
    return coverage.attempt_grid(region.select(F.col("r_name").alias("theme")), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "6-NONE"], attempts, skips)


@query("""
SELECT strftime(first, '%Y-%m-%d') AS day, count(*) AS n_new, sum(count(*)) OVER (ORDER BY strftime(first, '%Y-%m-%d'))::BIGINT AS n_codes FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY 1) GROUP BY 1
""")
def audit_rollup_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    births = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("day"))
    return coverage.cumulative_codes(births, "day")


@query("""
WITH e AS (SELECT event_type AS a, (user_id % 4)::VARCHAR AS b, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id % 3 END AS c, event_id % 10 AS t FROM events)
SELECT 'type' AS kind, a AS "key", count(*) AS n, sum(t)::BIGINT AS tokens FROM e GROUP BY a UNION ALL SELECT 'step', b, count(*), sum(t)::BIGINT FROM e GROUP BY b UNION ALL SELECT 'model', c, count(*), sum(t)::BIGINT FROM e WHERE c IS NOT NULL GROUP BY c
""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")))
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("decision_type"), (F.col("user_id") % 4).alias("step"), model.alias("model"), (F.col("event_id") % 10).alias("tokens"))
    return coverage.audit_summary(log)


_QUOTES = """
q AS (SELECT doc_id, text AS s, CASE doc_id % 4 WHEN 0 THEN substr(text, 6, 20) WHEN 1 THEN lower(substr(text, 6, 20)) WHEN 2 THEN substr(text, 1, 12) ELSE 'no such words at all' END AS t, doc_id % 3 = 0 AS old FROM documents),
n AS (SELECT *, lower(trim(regexp_replace(nfc_normalize(t), '[\\s\\p{Z}]+', ' ', 'g'))) AS nt, lower(trim(regexp_replace(nfc_normalize(s), '[\\s\\p{Z}]+', ' ', 'g'))) AS ns,
             lower(trim(regexp_replace(nfc_normalize(substr(s, 6, 20)), '[\\s\\p{Z}]+', ' ', 'g'))) AS np, length(s) >= 25 AS fits FROM q),
v AS (SELECT doc_id, CASE WHEN fits AND substr(s, 6, 20) = t THEN 'string_match' WHEN fits AND np = nt THEN 'normalized_match' WHEN nt <> '' AND contains(ns, nt) THEN 'substring_search' END AS method, old FROM n)
""".replace("\\\\", "\\")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("text"), F.col("doc_id") % 4
    said = F.when(k == 0, F.substring(s, 6, 20)).when(k == 1, F.lower(F.substring(s, 6, 20))).when(k == 2, F.substring(s, 1, 12)).otherwise("no such words at all")
    digest = F.when(F.col("doc_id") % 3 == 0, text.text_digest(F.concat(s, F.lit("x")))).otherwise(text.text_digest(s))
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("source_text"), said.alias("exact_text"), F.lit(5).alias("start_char"), F.lit(25).alias("end_char"), digest.alias("source_sha256"), F.col("lang").alias("citation_source"))
    return quotes.verified(rows)


@query(f"WITH {_QUOTES} SELECT doc_id, method, CASE WHEN method = 'string_match' THEN 'verified_exact' WHEN method IS NOT NULL THEN 'verified_fuzzy' WHEN old THEN 'drifted' ELSE 'fabricated' END AS status, CASE method WHEN 'string_match' THEN 1.0 WHEN 'normalized_match' THEN 0.95 WHEN 'substring_search' THEN 0.85 END::DOUBLE AS score FROM v")
def quote_verification_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("doc_id", "method", "status", "score")


@query(f"""
WITH {_QUOTES}, r AS (SELECT CASE WHEN method = 'string_match' THEN 'verified_exact' WHEN method IS NOT NULL THEN 'verified_fuzzy' WHEN old THEN 'drifted' ELSE 'fabricated' END AS status, method, lang FROM v JOIN documents USING (doc_id))
SELECT 'status' AS kind, status AS "key", count(*) AS n, count(*) FILTER (status LIKE 'verified%') AS n_verified FROM r GROUP BY 2
UNION ALL SELECT 'method', method, count(*), count(*) FILTER (status LIKE 'verified%') FROM r WHERE method IS NOT NULL GROUP BY 2
UNION ALL SELECT 'citation_source', lang, count(*), count(*) FILTER (status LIKE 'verified%') FROM r GROUP BY 2
""")
def quote_provenance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.provenance(_quotes(spark, sf_dir))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a small, fixed table that documents quote word for word: one scan, the passages in an array."""
    items = table(spark, sf_dir, "benchmark").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    found = table(spark, sf_dir, "documents").crossJoin(F.broadcast(items))  # one row, the size of the benchmark
    return found.select("doc_id", F.explode(F.filter("items", lambda i: F.col("text").contains(i["text"]))).alias("i")).select("i.item_id", "doc_id")


@query("SELECT doc_id AS std_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def analytic_sample_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    codes = labels.where("quality = 1").select(F.col("doc_id").alias("std_id"), F.lit("good").alias("code_key"))
    results = labels.select(F.col("doc_id").alias("std_id"), (F.col("toxic") == 1).alias("skipped"))
    return coding.analytic_sample(_entries(spark, sf_dir).select("std_id", "lang"), results, codes)


@query("""
WITH d AS (SELECT doc_id AS n_coded, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS l FROM documents),
w AS (SELECT n_coded, sum(coalesce(len(l), 0)) AS k_assigned FROM d GROUP BY 1), f AS (SELECT c, min(n_coded) AS b FROM (SELECT n_coded, unnest(l) AS c FROM d) GROUP BY 1), g AS (SELECT b AS n_coded, count(*) AS k FROM f GROUP BY 1),
r AS (SELECT w.n_coded, sum(coalesce(k, 0)) OVER (ORDER BY w.n_coded)::BIGINT AS n_codes, sum(coalesce(k, 0)) OVER (ORDER BY w.n_coded RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)::BIGINT AS n_recent, sum(k_assigned) OVER (ORDER BY w.n_coded) AS a FROM w LEFT JOIN g USING (n_coded))
SELECT n_coded, n_codes, n_recent, round(n_codes / nullif(a, 0), 9)::DOUBLE AS slope FROM r
""")
def saturation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words first seen in each document, those of the last fifty, and words so far by words assigned."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n_coded"), F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("_words"))
    births = docs.select("n_coded", F.explode("_words").alias("c")).groupBy("c").agg(F.min("n_coded").alias("n_coded")).groupBy("n_coded").agg(F.count("*").alias("k"))
    assigned = docs.groupBy("n_coded").agg(F.sum(F.coalesce(F.size("_words"), F.lit(0))).alias("n_assigned"))
    rows = assigned.join(births, "n_coded", "left").select("n_coded", F.coalesce("k", F.lit(0)).cast("long").alias("n_births"), "n_assigned")
    return coding.saturation_curve(rows, 50).withColumn("slope", F.round("slope", 9))


@query("""
WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label AS code_key, list(a ORDER BY i) AS v FROM (SELECT label, i, avg(v) AS a FROM x GROUP BY ALL) GROUP BY label),
e AS (SELECT vec_id AS std_id, embedding::DOUBLE[] AS u FROM embeddings), s AS (SELECT std_id, code_key, list_cosine_similarity(u, v) AS x FROM e, c)
SELECT std_id, code_key, round(x, 6) AS score, row_number() OVER (PARTITION BY std_id ORDER BY round(x, 12) DESC, code_key)::INT AS place FROM s QUALIFY place <= 3
""")
def semantic_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest codes of every vector: a code is a label, its vector the mean of all that have it."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    book = means.groupBy(F.col("label").alias("code_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))
    out = coding.semantic_top_codes(rows.select(F.col("vec_id").alias("std_id"), F.col("embedding").alias("vector")), book, 3)
    return out.withColumn("score", F.round("score", 6))


@query("""
WITH b AS (SELECT p_brand AS k, count(*) AS f, min(p_partkey) AS o FROM part GROUP BY 1),
r AS (SELECT k, 2 AS p, 'frequent' AS why, -f AS o FROM (SELECT * FROM b ORDER BY f DESC, k LIMIT 10) UNION ALL SELECT k, 3, 'recent', -o FROM (SELECT * FROM b ORDER BY o DESC LIMIT 5)),
u AS (SELECT k, arg_min(why, (p, o)) AS why, min((p, o)) AS po FROM r GROUP BY k)
SELECT k AS code_key, why, row_number() OVER (ORDER BY po, k)::INT AS rank FROM u QUALIFY rank <= 12
""")
def codebook_budget_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code_key")).agg(F.count("*").alias("frequency"), F.min("p_partkey").alias("birth_ord"))
    return coding.prompt_codes(book, most=12, top=10, recent=5)


@query("""
WITH RECURSIVE r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, greatest(1, ceil(least(length(coalesce(text, '')), 800) / 4))::INT AS tokens FROM documents),
g AS (SELECT source, doc_id, k, tokens, 1 AS batch, tokens AS held, 1 AS n FROM r WHERE k = 1 UNION ALL
      SELECT r.source, r.doc_id, r.k, r.tokens, CASE WHEN n >= 15 OR held + r.tokens > 20000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 15 OR held + r.tokens > 20000 THEN r.tokens ELSE held + r.tokens END, CASE WHEN n >= 15 OR held + r.tokens > 20000 THEN 1 ELSE n + 1 END
      FROM g JOIN r ON r.source IS NOT DISTINCT FROM g.source AND r.k = g.k + 1)
SELECT source, doc_id AS std_id, tokens, batch FROM g
""")
def dynamic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source packed in order into batches for a model."""
    return coding.batches(_entries(spark, sf_dir), "std_id", "source")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INT AS n_keys FROM events")
def json_props_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.map_values(props), 1).alias("first_value"), F.size(F.map_keys(props)).alias("n_keys"))
