"""Queries on text functions, answers of models, quotes and coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas, text
from ..operators import agreement, coding, hierarchy, lifecycle, quotes, themes
from .corpus import _MEMBERS, _QUOTES, _SCORE, _SEGMENTS, _entries, _membership, _quotes, _scored, _segments, _theme_codes, _theme_rows
from .registry import query, table


@query("SELECT p_partkey, 'aé b <U+D800> ' || p_name || ' 😀 <U+12>' AS said FROM part")
def unicode_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes of code points decoded where they are characters."""
    said = F.concat(F.lit("a<U+00E9> b <U+D800> "), F.col("p_name"), F.lit(" <U+1F600> <U+12>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean(said, text.CleaningRules("generic")).alias("said"))


@query("SELECT p_partkey, trim(p_name) AS name FROM part")
def code_names_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    said = F.when(k == 0, F.concat(F.lit('1. NEW: "'), name, F.lit('"'))).when(k == 1, F.concat(F.lit("new: 12. "), name)).when(k == 2, F.concat(F.lit("“"), name, F.lit("”"))).when(k == 3, F.concat(F.lit(" '"), name, F.lit("' "))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_code_name(said).alias("name"))


_HEAD = "substr(t, 1, 56)"
_CUT = rf"trim(regexp_replace({_HEAD}, '(?s)[\t\n\x0B\f\r ][^\t\n\x0B\f\r ]*$', ''))"


@query(f"SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE (CASE WHEN {_CUT} = '' THEN {_HEAD} ELSE {_CUT} END) || ' ...' END AS quote FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents)")
def quotes_cut_at_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated_at_word(F.replace("text", F.lit("\n"), F.lit(" ")), 60).alias("quote"))


@query(r"""
SELECT p_partkey, substr(lower(regexp_replace(trim(regexp_replace(x, '[^A-Za-z0-9 _-]', '', 'g')), '\s+', '_', 'g')), 1, 80) AS file,
       lower(regexp_replace(trim(regexp_replace(x, '[^A-Za-z0-9 -]', '', 'g')), '\s+', '-', 'g')) AS anchor FROM (SELECT p_partkey, 'A/B: ' || p_name || '  (#' || p_size || ' ü)' AS x FROM part)
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("A/B: "), F.col("p_name"), F.lit("  (#"), F.col("p_size").cast("string"), F.lit(" ü)"))
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_filename(name).alias("file"), text.anchor_id(name).alias("anchor"))


@query("SELECT c_custkey, '[c_acctbal: ' || CASE WHEN c_acctbal = floor(c_acctbal) THEN format('{:,}', c_acctbal::BIGINT) ELSE format('{:,.2f}', c_acctbal) END || '; c_custkey: ' || format('{:,}', c_custkey) || ']' AS tag FROM customer")
def metric_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.metric_tag(["c_acctbal", "c_custkey"]).alias("tag"))


@query(r"""
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS markup, sha256('"' || replace(html, '"', '""') || '"') AS field,
       sha256(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS xml, sha256(regexp_replace(replace('a|' || html, '|', '\|'), '[\r\n]+', ' ', 'g')) AS cell FROM pages
""")
def markup_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    made = {"markup": text.markup_escaped(html), "field": text.csv_field(html), "xml": text.xml_characters(html), "cell": text.table_cell(F.concat(F.lit("a|"), html))}
    return table(spark, sf_dir, "pages").select("page_id", *(text.text_digest(c).alias(k) for k, c in made.items()))


@query("SELECT p_partkey, 'see a and data:text/x [b](https://h.org/x) <mailto:m@h.org> [c](#d) ' || p_name AS said FROM part")
def links_defanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of unsafe schemes reduced to their words."""
    said = F.concat(F.lit("see [a](javascript:alert) and <data:text/x> [b](https://h.org/x) <mailto:m@h.org> [c](#d) "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.without_unsafe_links(said).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 7 < 5 THEN event_type || event_id END AS description FROM events")
def json_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as models write them: plain, fenced, cut short, with words around, cut within a string, or none."""
    k, value = F.col("event_id") % 7, F.concat("event_type", F.col("event_id").cast("string"))
    plain = F.concat(F.lit('{"description": "'), value, F.lit('"}'))
    short = F.concat(F.lit('{"description": "'), value, F.lit('", "more": [1, {"x": "y'))
    said = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(k == 2, short).when(k == 3, F.concat(F.lit("Sure: "), plain, F.lit(" Does that help?"))).when(k == 4, F.concat(F.lit('{"description": "'), value)).when(k == 5, "no answer")
    return table(spark, sf_dir, "events").select("event_id", schemas.answer(said, "description")["description"].alias("description"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'keep' ELSE 'none' END AS action, event_type AS target, least(1, greatest(0, value / 100))::DOUBLE AS confidence FROM events
""")
def answers_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed answers; words outside a list take the default, numbers are brought within bounds."""
    said = F.concat(F.lit('{"action": "'), F.element_at(F.array(F.lit("MERGE"), F.lit("Keep"), F.lit("explode")), (F.col("event_id") % 3 + 1).cast("int")), F.lit('", "target": "'), F.col("event_type"), F.lit('"}'))
    rows = table(spark, sf_dir, "events").withColumn("a", schemas.answer(said, "theme_decision"))
    within = coding.clamped_scores(rows.select("event_id", "a", (F.col("value") / 100).alias("confidence"), F.lit(0.0).alias("sentiment_score"), F.lit(0.0).alias("emotion_intensity"), F.array("event_type").alias("emotions")))
    return within.select("event_id", schemas.one_of(F.col("a.action"), ("merge", "keep"), "none").alias("action"), "a.target", "confidence")


@query("""
SELECT event_id, CASE WHEN value > 300 THEN 1.0 WHEN value < 5 THEN -1.0 ELSE (value - 100) / 200 END::DOUBLE AS sentiment_score, event_type || '; b' AS all_emotions,
       CASE WHEN event_id % 3 <> 0 THEN least(1, value / 50) END::DOUBLE AS emotion_intensity FROM events
""")
def clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(v > 300, 7.5).when(v < 5, -3.0).otherwise((v - 100) / 200).alias("sentiment_score"), F.lit(0.5).alias("confidence"), F.when(F.col("event_id") % 3 != 0, v / 50).alias("emotion_intensity"), F.array("event_type", F.lit("b")).alias("emotions"))
    return coding.clamped_scores(rows).select("event_id", "sentiment_score", "all_emotions", "emotion_intensity")


@query("SELECT event_id, value + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS value FROM events")
def restored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a run cut short take the place of new ones."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("std_id"), "value")
    earlier = rows.where("std_id % 4 = 0").withColumn("value", F.col("value") + 1)
    return coding.restored(rows, earlier, ["value"]).withColumnRenamed("std_id", "event_id")


# --- quotes ---------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN strpos(text, q) > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 10 ELSE strpos(text, q) - 1 END END::INT AS start, CASE WHEN strpos(text, q) > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 10 + length(q) ELSE strpos(text, q) - 1 + length(q) END END::INT AS \"end\" FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'no such words' ELSE substr(text, 11, 25) END AS q FROM documents WHERE length(text) > 40)")
def quotes_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of quotes, stale in every other document, resolved anew by the first occurrence."""
    said = F.when(F.col("doc_id") % 5 == 0, "no such words").otherwise(F.substring("text", 11, 25))
    start = F.when(F.col("doc_id") % 2 == 0, 10).otherwise(3)
    rows = table(spark, sf_dir, "documents").where(F.char_length("text") > 40).select("doc_id", "text", said.alias("q"), start.alias("s"))
    at = quotes.located(F.col("text"), F.col("q"), F.col("s"), F.col("s") + F.char_length("q"))
    return rows.select("doc_id", at.alias("at")).select("doc_id", "at.start", "at.end")


@query(r"SELECT doc_id, length(e) >= 5 AND contains(s, e) AS found FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS s, lower(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'nowhere said' WHEN doc_id % 3 = 1 THEN 'abc' ELSE substr(text, 3, 30) END, '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS e FROM documents)")
def excerpts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    said = F.when(k == 0, "nowhere said").when(k == 1, "abc").otherwise(F.replace(F.substring("text", 3, 30), F.lit(" "), F.lit(" \n ")))
    return table(spark, sf_dir, "documents").select("doc_id", quotes.excerpt_found(said, F.col("text")).alias("found"))


@query("SELECT doc_id, 'qte_' || sha1(doc_id || '|5|25|' || substr(text, 6, 20)) AS quote_id, sha256(text) AS source_sha256 FROM documents")
def quotes_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(5).alias("s"), F.lit(25).alias("e"), F.substring("text", 6, 20).alias("q"))
    return quotes.made(rows, "doc_id", "text", "s", "e", "q").select("doc_id", "quote_id", "source_sha256")


@query(f"""
WITH {_QUOTES}, r AS (SELECT CASE WHEN method IS NOT NULL THEN 'verified' WHEN old THEN 'drifted' ELSE 'fabricated' END AS s FROM v)
SELECT count(*) AS total, round(avg((s = 'verified')::INT), 9) AS verification_rate, round(avg((s = 'fabricated')::INT), 9) AS fabrication_rate, round(avg((s = 'drifted')::INT), 9) AS drift_rate FROM r
""")
def provenance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.provenance_rates(_quotes(spark, sf_dir))
    return out.select("total", *(F.round(c, 9).alias(c) for c in ("verification_rate", "fabrication_rate", "drift_rate")))


@query("SELECT item_id, doc_id, doc_id IS NOT NULL AS known FROM (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)")
def quotes_against_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes of the first document that has them, verified against the corpus; of others the entry is unknown."""
    items = table(spark, sf_dir, "benchmark").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))  # a fixed, small table
    docs = table(spark, sf_dir, "documents")
    hits = docs.crossJoin(F.broadcast(items)).select("doc_id", F.explode(F.filter("items", lambda i: F.col("text").contains(i["text"]))).alias("i")).groupBy("i.item_id").agg(F.min("doc_id").alias("std_id"))
    said = table(spark, sf_dir, "benchmark").join(hits, "item_id", "left").select("item_id", "std_id", F.col("text").alias("exact_text"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), F.lit("").alias("source_sha256"))
    out = quotes.against_corpus(said, docs.select(F.col("doc_id").alias("std_id"), F.col("text").alias("std_text")))
    return out.select("item_id", F.col("std_id").alias("doc_id"), F.col("status").startswith("verified").alias("known"))


# --- codes and themes -----------------------------------------------------------------------


@query(f"WITH {_MEMBERS} SELECT std_id, max((theme = 'legal')::INT) = 1 AS legal, false AS leg FROM m GROUP BY 1")
def entry_in_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = themes.joined_labels(_membership(spark, sf_dir))
    return cells.select("std_id", themes.in_theme(F.col("emerged_themes"), "legal").alias("legal"), themes.in_theme(F.col("emerged_themes"), "leg").alias("leg"))


@query(f"WITH {_SEGMENTS} SELECT doc_id AS std_id, coalesce(length(text), 0) < 10 AS skipped, CASE WHEN coalesce(length(text), 0) < 10 THEN 'too short' END AS skip_reason, count(DISTINCT code_key) AS n_codes FROM documents LEFT JOIN s ON std_id = doc_id GROUP BY doc_id, text")
def entry_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.entry_results(_entries(spark, sf_dir), _segments(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT code_key, slug, count(*) AS n FROM (SELECT code_key, CASE WHEN code_key NOT IN ('the', 'die') THEN code_key END AS slug FROM s) GROUP BY ALL")
def outside_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a framework's constructs, and the others with a slug."""
    constructs = spark.createDataFrame([("the",), ("die",)], "id string")
    inside, outside = coding.outside_framework(_segments(spark, sf_dir), constructs)
    return inside.withColumn("slug", F.lit(None).cast("string")).unionByName(outside).groupBy("code_key", "slug").agg(F.count("*").alias("n"))


@query(f"WITH {_SEGMENTS} SELECT CASE WHEN code_key IN ('the', 'die') THEN 'article' WHEN code_key = 'rights' THEN 'law' ELSE code_key END AS code_key, count(*) AS n FROM (SELECT * FROM s WHERE code_key <> 'numbers' UNION ALL SELECT std_id, 'licence', t FROM s WHERE code_key = 'license') GROUP BY 1")
def reviewed_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's edits: two codes merged, one renamed, one split, one deleted."""
    edits = spark.createDataFrame([("the", "merge", "article"), ("die", "merge", "article"), ("rights", "rename", "law"), ("license", "split", "licence"), ("numbers", "delete", None), ("les", "keep", None)], "code_key string, action string, target string")
    return coding.reviewed_codes(_segments(spark, sf_dir), edits).groupBy("code_key").agg(F.count("*").alias("n"))


@query(f"WITH {_MEMBERS}, e AS (SELECT DISTINCT std_id, CASE WHEN theme IN ('english', 'german') THEN 'germanic' WHEN theme = 'french' THEN 'romance' ELSE theme END AS theme FROM m WHERE theme <> 'figures') SELECT theme, count(*) AS n FROM e GROUP BY 1")
def reviewed_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = spark.createDataFrame([("english", "merge", "germanic"), ("german", "merge", "germanic"), ("french", "rename", "romance"), ("figures", "delete", None)], "theme string, action string, target string")
    return coding.reviewed_themes(_membership(spark, sf_dir), edits).groupBy("theme").agg(F.count("*").alias("n"))


@query(f"WITH {_MEMBERS}, c AS (SELECT CASE code_key WHEN 'rights' THEN 'legal' WHEN 'license' THEN 'legal' WHEN 'the' THEN 'english' WHEN 'die' THEN 'german' WHEN 'les' THEN 'french' ELSE 'figures' END AS theme, code_key FROM (SELECT DISTINCT code_key FROM s)), n AS (SELECT theme, count(DISTINCT std_id) AS n_entries FROM m GROUP BY 1) SELECT theme, coalesce(n_entries, 0) AS n_entries, string_agg(code_key, '; ' ORDER BY code_key) AS codes FROM c LEFT JOIN n USING (theme) GROUP BY ALL")
def theme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a theme with its entries and codes."""
    used = _theme_codes(spark).join(_segments(spark, sf_dir).select("code_key").distinct(), "code_key")
    return hierarchy.theme_table(_membership(spark, sf_dir), used)


@query(f"WITH {_MEMBERS} SELECT theme, count(DISTINCT std_id) AS n FROM m GROUP BY 1 ORDER BY n DESC, theme LIMIT 3")
def frequent_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent themes: a report's top three."""
    return themes.frequent_labels(_membership(spark, sf_dir), 3)


@query("""
WITH k AS (SELECT p_type AS kind, p_brand AS theme, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, theme) AS i FROM k)
SELECT kind, count(*) AS n_themes, list(theme ORDER BY i) FILTER (i <= 5) AS top FROM r GROUP BY kind
""")
def theme_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("theme")).agg(F.count("*").alias("n_entries"))
    return themes.theme_set_summary(rows)


@query(f"""
WITH {_MEMBERS}, b AS (SELECT std_id, count(*) AS breadth FROM m GROUP BY 1), r AS (SELECT theme, std_id, breadth FROM m JOIN b USING (std_id)), q AS (SELECT theme, quantile_cont(breadth, 0.5) AS med FROM r GROUP BY 1),
k AS (SELECT r.*, breadth <= med AS narrow, count(*) FILTER (breadth <= med) OVER (PARTITION BY theme) >= 3 AS enough FROM r JOIN q USING (theme))
SELECT theme, std_id FROM k WHERE narrow OR NOT enough
""")
def specific_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each theme the entries no broader than its median entry."""
    members = _membership(spark, sf_dir)
    breadth = members.groupBy("std_id").agg(F.count("*").alias("breadth"))
    return themes.specific_entries(members.join(breadth, "std_id")).select("theme", "std_id")


@query(f"""
WITH {_MEMBERS}, e AS (SELECT theme, std_id, n_chars, {_SCORE} AS s, replace(replace(text, chr(10), ' '), chr(9), ' ') AS t FROM m JOIN documents ON doc_id = std_id WHERE length(text) > 50),
r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY s, std_id) AS i, count(*) OVER (PARTITION BY theme) AS n FROM e)
SELECT theme, std_id, CASE WHEN i = 1 THEN 'most_negative' WHEN n >= 3 AND i = ceil(n / 2) THEN 'median' ELSE 'most_positive' END AS position,
       (CASE WHEN length(t) <= 60 THEN t ELSE (CASE WHEN {_CUT} = '' THEN {_HEAD} ELSE {_CUT} END) || ' ...' END) || ' [n_chars: ' || format('{{:,}}', n_chars) || ']' AS quote FROM r WHERE i = 1 OR (n >= 3 AND i = ceil(n / 2)) OR (n >= 2 AND i = n)
""")
def tagged_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme quotes cut at a word, with a tag of their metrics."""
    rows = _theme_rows(spark, sf_dir).withColumn("std_text", F.translate("std_text", "\n\t", "  "))
    return themes.tagged_quotes(rows, "sentiment_score", "std_id", ["n_chars"], 60)


@query(f"WITH {_MEMBERS} SELECT doc_id AS std_id FROM documents WHERE doc_id NOT IN (SELECT std_id FROM m WHERE theme = 'legal') ORDER BY md5('42' || doc_id), doc_id LIMIT 25")
def counter_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 25 entries outside a theme: the sample is the feature."""
    return lifecycle.counter_entries(_entries(spark, sf_dir), _membership(spark, sf_dir), "legal").select("std_id")


@query(f"WITH {_MEMBERS} SELECT doc_id AS std_id, sha256(substr(text, 1, 400)) AS said FROM documents WHERE doc_id IN (SELECT std_id FROM m WHERE theme = 'legal')")
def supporting_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of a theme, each by its first 400 characters, which is what a prompt shows."""
    out = lifecycle.supporting_entries(_entries(spark, sf_dir), _membership(spark, sf_dir), "legal")
    return out.select("std_id", text.text_digest(F.col("text")).alias("said"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE i IN (SELECT round_even(1 + k * (any_value(n) - 1) / 24, 0)::BIGINT FROM r, range(25) s(k) GROUP BY k)")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 documents evenly spaced in their order: the sample is the feature."""
    return coding.even_sample(table(spark, sf_dir, "documents"), "doc_id", 25).select("doc_id")


@query("WITH s AS (SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 20) SELECT doc_id FROM s")
def verification_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that a person codes again: the sample is the feature."""
    return agreement.sampled(table(spark, sf_dir, "documents"), "doc_id").select("doc_id")


@query("SELECT doc_id AS std_id, list_sort(list_filter([lang, CASE WHEN quality = 1 THEN 'good' END], lambda x: x IS NOT NULL)) AS a, list_sort(list_filter([lang, CASE WHEN n_chars > 1500 THEN 'long' END], lambda x: x IS NOT NULL)) AS b FROM documents JOIN labels USING (doc_id)")
def coding_sheets_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coders' sheets of wide columns, read back as sets and joined by entry."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("std_id", F.col("doc_id"))
    sheets = []
    for extra in (F.when(F.col("quality") == 1, " GOOD"), F.when(F.col("n_chars") > 1500, "long ")):
        codes = docs.select("std_id", F.explode(F.array_compact(F.array(extra, F.col("lang"), F.upper("lang")))).alias("code"))
        sheets.append(agreement.sheet_sets(agreement.coding_sheet(docs.select("std_id"), codes)))
    out = agreement.paired(*sheets)
    return out.select("std_id", F.array_sort("a").alias("a"), F.array_sort("b").alias("b"))


@query("SELECT c_custkey, CASE WHEN k IS NULL THEN NULL WHEN k >= 0.81 THEN 'almost perfect' WHEN k >= 0.61 THEN 'substantial' WHEN k >= 0.41 THEN 'moderate' WHEN k >= 0.21 THEN 'fair' WHEN k >= 0 THEN 'slight' ELSE 'poor' END AS kappa, CASE WHEN k >= 0.8 THEN 'reliable' WHEN k >= 0.667 THEN 'tentative' WHEN k IS NOT NULL THEN 'unreliable' END AS alpha FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 10000 END AS k FROM customer)")
def agreement_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 10000)
    return table(spark, sf_dir, "customer").select("c_custkey", agreement.kappa_band(k).alias("kappa"), agreement.alpha_band(k).alias("alpha"))


@query("""
WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY name) AS i, name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT lower(r_name) || 's' FROM region)),
r AS (SELECT i, name, name AS label, [name] AS kept FROM l WHERE i = 1
      UNION ALL SELECT l.i, l.name, coalesce(list_filter(r.kept, lambda k: 1 - jaro_similarity(l.name, k) <= 0.15)[1], l.name), CASE WHEN len(list_filter(r.kept, lambda k: 1 - jaro_similarity(l.name, k) <= 0.15)) = 0 THEN list_append(r.kept, l.name) ELSE r.kept END FROM r JOIN l ON l.i = r.i + 1)
SELECT name, label FROM r
""")
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a codebook, each with the first like it; the labels are a few dozen and are gathered."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(F.col("n_name").alias("name")).union(region.select("r_name")).union(region.select(F.concat(F.lower("r_name"), F.lit("s")))).distinct()
    found = agreement.canonical_labels(sorted(r["name"] for r in names.collect()))
    return spark.createDataFrame(sorted(found.items()), "name string, label string")


@query("WITH w AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS c FROM benchmark), f AS (SELECT c, min(item_id) AS b FROM w GROUP BY 1) SELECT c AS code_key, (row_number() OVER (ORDER BY b) - 1)::BIGINT AS born, (SELECT count(*) FROM w WHERE w.c = f.c) AS n FROM f")
def inductive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inductive coding of the benchmark's passages in order, each seen with the codes before it, by a coder that takes first words."""

    def coder(rows: list[dict], book: list[str]) -> list[dict]:
        return [{"std_id": r["std_id"], "code_key": r["std_text"].split(" ")[0].lower(), "text": r["std_text"]} for r in rows]

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("std_id"), F.col("text").alias("std_text"), F.col("item_id").alias("row_ord"))
    segments, book, _ = coding.fold(items, coder, batch=3)
    n = {k: sum(s["code_key"] == k for s in segments) for k in book}
    return spark.createDataFrame([(k, i, n[k]) for i, k in enumerate(book)], "code_key string, born long, n long")


@query("SELECT count(*) AS n_docs, greatest(20, ceil(count(*) / 50))::BIGINT AS cadence, (SELECT count(DISTINCT lang) FROM documents WHERE doc_id <= 40) AS n_codes FROM documents")
def saturation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often saturation is asked for, and the curve of languages at its point nearest to 40.4."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    births = docs.groupBy("lang").agg(F.min("doc_id").alias("n_coded")).groupBy("n_coded").agg(F.count("*").alias("k"))
    rows = docs.select(F.col("doc_id").alias("n_coded"), F.lit(1).alias("n_assigned")).distinct().join(births, "n_coded", "left").select("n_coded", "n_assigned", F.coalesce("k", F.lit(0)).alias("n_births"))
    return coding.nearest_point(coding.saturation_curve(rows, 50), 40.4).select(F.lit(n).cast("long").alias("n_docs"), F.lit(coding.saturation_cadence(n)).cast("long").alias("cadence"), "n_codes")


@query(f"SELECT doc_id AS std_id, round({_SCORE}, 9)::DOUBLE AS score, CASE WHEN {_SCORE} < -0.2 THEN 'negative' WHEN {_SCORE} > 0.2 THEN 'positive' ELSE 'mixed' END AS tendency, CASE WHEN abs({_SCORE}) >= 0.3 THEN 'high' WHEN abs({_SCORE}) >= 0.1 THEN 'medium' ELSE 'low' END AS band FROM documents")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentiment_score")
    return _scored(spark, sf_dir).select("std_id", F.round(s, 9).alias("score"), themes.tendency(s).alias("tendency"), themes.prevalence_band(F.abs(s)).alias("band"))
