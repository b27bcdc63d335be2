"""Queries that load sources, or write what a run leaves behind and read it back."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_digest
from ..operators import comparison, lifecycle
from ..sinks import exports
from ..sources import codebooks, config, ingest, manuscripts, runs
from ..sources.storage import put, scratch
from . import analysis, over_time  # noqa: F401 - over_time registers the SQL that is asked for below
from .corpus import _MEMBERS, _QUOTES, _SEGMENTS, _entries, _membership, _quotes, _segments
from .registry import ORACLES, query, table
from .runs import _NODES

# --- loading --------------------------------------------------------------------------------


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 100")
def loaded_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that an SQL query over the tables gives."""
    tables = {"documents": table(spark, sf_dir, "documents")}
    return ingest.loaded(spark, tables, query="SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 100")


@query("SELECT 'named' AS kind, count(*) AS n FROM region UNION ALL SELECT 'largest', count(*) FROM customer")
def loaded_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a corpus's name, else the one with most rows."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    picked = (("named", ingest.loaded(spark, {"meta": customer, "Posts": region})), ("largest", ingest.loaded(spark, {"nation": nation, "customer": customer, "region": region})))
    return picked[0][1].agg(F.lit("named").alias("kind"), F.count("*").alias("n")).unionByName(picked[1][1].agg(F.lit("largest").alias("kind"), F.count("*").alias("n")))


@query(ORACLES["clean_dedup_first"].replace("SELECT std_id, length(t)::INT AS chars, sha256(t) AS sha", "SELECT std_id::VARCHAR AS std_id, sha256(t) AS sha"))
def corpus_from_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus that settings describe: a named table, standardised, cleaned, within lengths, first of each text."""
    settings = config.loaded("{}", {"data.source_type": "generic", "data.table": "documents"})
    rows = analysis.corpus(spark, {"nation": table(spark, sf_dir, "nation"), "documents": table(spark, sf_dir, "documents")}, settings)
    return rows.select("std_id", text_digest(F.col("std_text")).alias("sha"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id < 30)")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key isn't stored yet, one of each."""
    events = table(spark, sf_dir, "events")
    return ingest.inserted(events.where("event_type = 'error' AND event_id < 30"), events, "user_id").select("user_id")


@query(f"WITH RECURSIVE {_NODES}, t AS (SELECT id FROM nodes WHERE id IN ('r1', 'r2') UNION SELECT n.id FROM nodes n JOIN t ON n.parent = t.id) SELECT id FROM t")
def expanded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids below two roots, level by level, each looked at once."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    links = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("next"))
    links = links.unionByName(supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("next")))
    return ingest.expanded(spark.createDataFrame([("r1",), ("r2",), ("r1",)], "id string"), links)


# --- codebooks and projects -----------------------------------------------------------------

_BOOKS = {
    "nvivo": ("Name", "Description", "Parent Name", "Number of coding references"),
    "atlasti": ("Code", "Comment", "Code Group 1", "Grounded"),
    "maxqda": ("Code System", "Memo", "Parent code", "Coded segments"),
    "generic": ("label", "definition", "parent", "count"),
}


def _book_rows(spark: SparkSession, sf_dir: str) -> list[dict[str, str]]:
    """Nations as codes under their regions, with how many suppliers each has: a codebook of 25 rows."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    n = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).join(n, "n_nationkey", "left").orderBy("n_nationkey").select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n")).collect()
    return [r.asDict() for r in rows]


_BOOK_SQL = "SELECT n_name AS code, 'about ' || n_name AS description, r_name AS parent, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS frequency, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(" UNION ALL ".join(f"SELECT '{t}' AS tool, * FROM ({_BOOK_SQL})" for t in _BOOKS))
def codebooks_of_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebooks as four tools export them, in CSV, under common names; the tool is known by its columns."""
    parts = []
    for tool, names in _BOOKS.items():
        lines = [",".join(names)] + [f'{r["n_name"]},"about {r["n_name"]}",{r["r_name"]},"{r["n"]:,} refs"' for r in _book_rows(spark, sf_dir)]
        rows = codebooks.csv_rows("﻿".encode() + "\n".join(lines).encode())
        parts.append(codebooks.codebook(spark, rows).select(F.lit(codebooks.tool_of(list(rows[0]))).alias("tool"), "code", "description", "parent", "frequency", "level"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _xlsx(rows: list[list[str]]) -> bytes:
    """A sheet with inline strings."""
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@query("SELECT n_name AS code, r_name AS parent, 2 AS level, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS frequency FROM nation JOIN region ON n_regionkey = r_regionkey")
def codebook_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook in a spreadsheet whose codes are paths, which give parents and levels."""
    data = _xlsx([["name", "count"]] + [[f"{r['r_name']}::{r['n_name']}", str(r["n"])] for r in _book_rows(spark, sf_dir)])
    return codebooks.codebook(spark, codebooks.xlsx_rows(data)).select("code", "parent", "level", "frequency")


@query("SELECT n_name AS code, r_name AS parent, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, 1 FROM region")
def codebook_of_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook whose lines are indented below their parents."""
    lines: list[dict[str, str]] = []
    rows = sorted(_book_rows(spark, sf_dir), key=lambda r: r["r_name"])
    for i, r in enumerate(rows):
        if not i or rows[i - 1]["r_name"] != r["r_name"]:
            lines.append({"name": r["r_name"]})
        lines.append({"name": f"  {r['n_name']}"})
    return codebooks.codebook(spark, lines).select("code", "parent", "level")


@query("SELECT n_nationkey::VARCHAR AS std_id, 'Region ' || n_regionkey AS code, 0 AS start_char, length(n_name)::INT AS end_char, n_name || ' & <more>' AS text FROM nation")
def projects_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interchange project written and read: codes, sources and the places that are coded."""
    nation = table(spark, sf_dir, "nation")
    entries = nation.select(F.col("n_nationkey").cast("string").alias("std_id"), F.concat("n_name", F.lit(" & <more>")).alias("std_text"))
    segments = nation.select(F.col("n_nationkey").cast("string").alias("std_id"), F.concat(F.lit("r"), "n_regionkey").alias("code_key"), F.lit(0).alias("start_char"), F.length("n_name").alias("end_char"))
    codes = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("code_key"), F.concat(F.lit("Region "), "n_regionkey").alias("name")).distinct()
    book, sources, refs = codebooks.qdpx(spark, exports.qdpx(entries, segments, codes))
    out = refs.join(book.select("guid", F.col("name").alias("code")), "guid").join(sources.withColumnRenamed("name", "std_id"), "source")
    return out.select("std_id", "code", "start_char", "end_char", "text")


# --- manuscripts ----------------------------------------------------------------------------


@query("SELECT r_name AS name, s.s AS section, CASE s.s WHEN 'methods' THEN 'We asked ' || r_name || chr(10) || 'twice.' WHEN 'abstract' THEN 'About ' || r_name ELSE 'Found.' || chr(10) || 'And more.' END AS text FROM region, (SELECT unnest(['abstract', 'methods', 'results']) AS s) s")
def manuscript_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuscripts in files, one a region, cut into sections by their headings; a repeated section is joined on."""
    folder = scratch(spark, "manuscripts")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        name = r["r_name"]
        put(spark, f"{folder}/{name}.md", f"A title\n# Abstract\nAbout {name}\n## 2. Methods\nWe asked {name}\ntwice.\n# Findings\nFound.\n3. Results\nAnd more.\n")
    rows = manuscripts.sections(manuscripts.documents(spark, folder))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "section", "text")


@query("SELECT c_custkey, '2024-05-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS date, 'u' || c_custkey AS username, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 5)::DOUBLE END AS rating, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::INT END AS likes FROM customer")
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the names of raw files say of them."""
    k = F.col("c_custkey")
    rating = F.when(k % 3 == 0, "N.A.").otherwise((k % 5).cast("string"))
    name = F.concat(F.lit("review_2024-05-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("_user-u"), k, F.lit("_rating_"), rating, F.when(k % 4 == 0, "_likes_N.A.").otherwise(F.concat(F.lit("_likes_"), k)), F.lit(".txt"))
    found = manuscripts.filename_metadata(name)
    return table(spark, sf_dir, "customer").select("c_custkey", *(c.alias(n) for n, c in found.items()))


# --- runs -----------------------------------------------------------------------------------

_FIRST, _SECOND = "run_2026-01-01_120000_M2", "run_2026-01-02_120000_M2"


def _run_folders(spark: SparkSession, sf_dir: str) -> str:
    """Two runs as folders of files: users of the two halves of a month, their scores, codes, correlations, themes and metadata."""
    base = scratch(spark, "runs")
    events = table(spark, sf_dir, "events").withColumn("late", F.dayofmonth("ts") > 15)
    for run, late in ((_FIRST, False), (_SECOND, True)):
        rows = events.where(F.col("late") == late)
        scores = rows.groupBy(F.col("user_id").cast("string").alias("std_id")).agg(F.count("*").cast("string").alias("std_text"), F.round(F.avg("value"), 6).alias("sentiment_score"), F.array_sort(F.collect_set("event_type")).alias("all_emotions"))
        wanted = scores.select("std_id", F.concat(F.lit("said \"it\", "), "std_text").alias("std_text"), "sentiment_score", "all_emotions", F.lit(1.0).alias("emotion_intensity"), F.lit(1.0).alias("confidence"), F.array_join("all_emotions", "; ").alias("emerged_themes"), F.lit("posts").alias("source_table"))
        exports.table(wanted, f"{base}/{run}/sentiment_scores.csv")
        book = rows.groupBy(F.col("event_type").alias("code_key")).agg(F.count("*").cast("int").alias("frequency"))
        exports.table(book.select("code_key", F.when(F.lit(late), F.upper("code_key")).otherwise(F.col("code_key")).alias("code_text"), F.lit("d").alias("code_type"), "frequency", F.col("frequency").alias("n_entries")), f"{base}/{run}/codes.csv", one_file=True)
        exports.table(rows.agg(F.lit("a").alias("var1"), F.lit("b").alias("var2"), F.lit(0.5).alias("correlation"), F.lit(0.01).alias("p_value"), F.lit("large").alias("effect_size"), F.lit(True).alias("significant"), F.lit(0.1).alias("ci_lower"), F.lit(0.9).alias("ci_upper")), f"{base}/{run}/correlations.csv", one_file=True)
        named = [{"name": r["event_type"], "entry_count": r["n"], "codes_included": f"{r['event_type']}; all"} for r in rows.groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()]  # a row a theme
        put(spark, f"{base}/{run}/themes.json", exports.stamped_json(json.loads(exports.stamped_json(named, {"mode": "M1"})), {"mode": "M2"}))
        put(spark, f"{base}/{run}/run_metadata.json", json.dumps({"provider": "p", "model_primary": f"m{int(late)}", "analysis_schema_version": "1.1"}))
    return base


_HALVES = f"r AS (SELECT CASE WHEN day(ts) <= 15 THEN '{_FIRST}' ELSE '{_SECOND}' END AS run_id, * FROM events)"


@query(f"WITH {_HALVES} SELECT run_id, user_id::VARCHAR AS std_id, 'said \"it\", ' || count(*) AS std_text, round(avg(value), 6) AS sentiment_score, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS all_emotions FROM r GROUP BY run_id, user_id")
def run_scores_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all runs of a folder, quotes and commas within texts included."""
    return runs.sentiment(spark, _run_folders(spark, sf_dir)).select("run_id", "std_id", "std_text", "sentiment_score", "all_emotions")


@query(f"WITH {_HALVES} SELECT run_id, event_type AS name, count(*)::INT AS entry_count, [event_type, 'all'] AS codes FROM r GROUP BY run_id, event_type")
def run_themes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of all runs from files in a stamp's envelope."""
    return runs.themes(spark, _run_folders(spark, sf_dir)).select("run_id", "name", "entry_count", "codes")


@query(f"SELECT unnest(['{_FIRST}', '{_SECOND}']) AS run_id, unnest(['m0', 'm1']) AS model_primary, true AS compatible")
def runs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.listed(spark, _run_folders(spark, sf_dir)).select("run_id", "model_primary", "compatible")


@query(f"""
WITH {_HALVES}, s AS (SELECT run_id, user_id, count(*) AS k, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS e FROM r GROUP BY run_id, user_id), a AS (SELECT * FROM s WHERE run_id = '{_SECOND}'), b AS (SELECT * FROM s WHERE run_id = '{_FIRST}'),
j AS (SELECT a.user_id AS x, b.user_id AS y, a.k <> b.k AS changed, a.e = b.e AS same FROM a FULL JOIN b ON a.user_id = b.user_id),
t AS (SELECT event_type FROM r WHERE run_id = '{_SECOND}' INTERSECT SELECT event_type FROM r WHERE run_id = '{_FIRST}')
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_shared, count(*) FILTER (y IS NULL) AS n_new, count(*) FILTER (x IS NULL) AS n_dropped, count(*) FILTER (changed) AS n_text_changes, count(*) FILTER (same) AS n_stable,
       (SELECT count(*) FROM t) AS n_persisted, (SELECT count(*) FROM t) AS n_same_codes, 2 AS n_correlated FROM j
""")
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of a folder against the one before, in one row of figures."""
    out = analysis.compared(spark, _run_folders(spark, sf_dir))
    one = out["samples"].select("n_shared", "n_new", "n_dropped", "n_text_changes")
    for df in (
        out["stability"].select("n_stable"),
        out["themes"].where("status = 'persisted'").agg(F.count("*").alias("n_persisted")),
        out["codes"].where("status = 'stable'").agg(F.count("*").alias("n_same_codes")),
        out["correlations"].where("status = 'persistent'").agg(F.max("n_runs").alias("n_correlated")),
    ):
        one = one.crossJoin(df)  # a row each
    return one


@query("SELECT n_name AS name, 'note of ' || n_name AS body FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def memos_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in files, by type and theme."""
    folder = scratch(spark, "memos")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        kind = lifecycle.MEMO_TYPES[r["n_nationkey"] % 2]
        put(spark, f"{folder}/{r['n_name']}.md", f"---\ntype: {kind}\nauthor: A B\nthemes: [\"t{r['n_regionkey']}\", all]\n---\nnote of {r['n_name']}\n")
    rows = lifecycle.memos(runs.memos(spark, folder), lifecycle.MEMO_TYPES[0], "A B", "t2")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "body")


@query("SELECT user_id::VARCHAR AS user_id, CASE event_type WHEN 'click' THEN 'assign_code' ELSE 'new_code' END AS decision_type, count(*) AS n FROM events GROUP BY ALL")
def audit_log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended to twice and read back, its further fields as a map."""
    folder = scratch(spark, "log")
    kind = F.when(F.col("event_type") == "click", "assign_code").otherwise("new_code")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("timestamp"), F.lit("coding").alias("step"), kind.alias("decision_type"), "user_id", "event_id")
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        exports.appended_log(part, folder)
    return runs.audit_log(spark, folder).groupBy(F.element_at("extras", "user_id").alias("user_id"), "decision_type").agg(F.count("*").alias("n"))


@query("SELECT 'partial' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'full', count(*) FROM customer UNION ALL SELECT 'none', 0")
def checkpoints_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's table: none at first, a partial one, and the full one in its place."""
    folder = scratch(spark, "checkpoints")
    found = {"none": runs.latest_checkpoint(spark, folder, "coding")}
    exports.checkpoint(table(spark, sf_dir, "nation"), folder, "coding", partial=True)
    found["partial"] = runs.latest_checkpoint(spark, folder, "coding").count()
    exports.checkpoint(table(spark, sf_dir, "customer"), folder, "coding")
    found["full"] = runs.latest_checkpoint(spark, folder, "coding").count()
    return spark.createDataFrame([(k, n or 0) for k, n in found.items()], "kind string, n long")


_PROMPT = "SELECT event_type || user_id % 5 AS prompt, min(event_id) AS first FROM events GROUP BY 1"


@query(f"SELECT prompt, CASE WHEN first % 2 = 0 THEN 'old ' || first ELSE 'new' END AS response FROM ({_PROMPT})")
def responses_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the response stored for their digest; what was stored first stays."""
    prompt = F.concat("event_type", (F.col("user_id") % 5).cast("string"))
    prompts = table(spark, sf_dir, "events").groupBy(prompt.alias("prompt")).agg(F.min("event_id").alias("first"))
    keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    stored = keyed.where("first % 2 = 0").select("prompt_hash", F.concat(F.lit("old "), "first").alias("response"))
    later = runs.new_responses(keyed.select("prompt_hash", F.lit("new").alias("response")), stored)
    return runs.cached_responses(prompts.select("prompt"), stored.unionByName(later)).select("prompt", "response")


# --- exports --------------------------------------------------------------------------------


@query(f"WITH {_MEMBERS} SELECT theme, std_id::VARCHAR AS std_id, sha256(text) AS sha FROM m JOIN documents ON doc_id = std_id")
def exported_by_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in a folder for each theme, read back with line ends and quotes as they were."""
    folder = scratch(spark, "themes")
    exports.entries_by_theme(_entries(spark, sf_dir).select("std_id", "std_text"), _membership(spark, sf_dir), folder)
    # The escape of an escape is U+0000 unless set, and dropped from quoted texts.
    rows = spark.read.schema("std_id string, std_text string, theme string").option("header", "true").option("escape", '"').option("charToEscapeQuoteEscaping", '"').option("multiLine", "true").csv(folder)
    return rows.select("theme", "std_id", text_digest(F.coalesce("std_text", F.lit(""))).alias("sha"))


@query("SELECT l_returnflag AS theme, l_linestatus AS subtheme, median(l_quantity) AS l_quantity_median, round(avg(l_quantity), 6) AS l_quantity_mean, count(*) AS l_tax_n FROM lineitem GROUP BY ALL")
def subtheme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a subtheme with its metrics side by side."""
    from ..functions.metrics import described_values

    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "theme", "l_linestatus": "subtheme"})
    long = [described_values(rows, m, ["median", "mad", "mean", "sd"], ["theme", "subtheme"]).withColumnsRenamed({"n_observed": "n"}).withColumn("metric", F.lit(m)) for m in ("l_quantity", "l_tax")]
    out = exports.subtheme_summary(long[0].unionByName(long[1]), ["l_quantity", "l_tax"])
    return out.select("theme", "subtheme", "l_quantity_median", F.round("l_quantity_mean", 6).alias("l_quantity_mean"), "l_tax_n")


@query(f"WITH {_SEGMENTS}, c AS (SELECT code_key, count(*) AS frequency FROM s GROUP BY 1) SELECT 'all' AS theme, list(code_key ORDER BY code_key) AS codes, sum(frequency)::BIGINT AS n FROM c")
def nested_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes with their codes as JSON lines, written and read back."""
    folder = scratch(spark, "nested")
    codes = _segments(spark, sf_dir).groupBy(F.lit("all").alias("theme"), "code_key").agg(F.count("*").alias("frequency"))
    exports.nested_themes(spark.createDataFrame([("all",)], "theme string"), codes).write.text(folder)
    rows = spark.read.schema("theme string, codes array<struct<code_key: string, frequency: long>>").json(folder)
    return rows.select("theme", F.transform("codes", lambda c: c["code_key"]).alias("codes"), F.aggregate("codes", F.lit(0).cast("long"), lambda t, c: t + c["frequency"]).alias("n"))


@query("SELECT count(*) AS n_input, count(*) FILTER (quality = 1) AS n_coded FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a corpus was looked at, as the JSON card that a run leaves."""
    from ..operators import coverage

    entries, labels = _entries(spark, sf_dir), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "std_id")
    card = json.loads(exports.coverage_card(coverage.coverage(entries, labels.select("std_id", F.lit(False).alias("skipped")), labels.where("quality = 1").select("std_id", F.lit("good").alias("code_key")))))
    return spark.createDataFrame([(card["n_input"], card["n_coded"])], "n_input long, n_coded long")


@query(f"WITH {_QUOTES} SELECT doc_id FROM v WHERE method IS NULL AND NOT old")
def fabricated_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that no source says: what the log of fabrications holds."""
    return exports.fabricated_only(_quotes(spark, sf_dir)).select("doc_id")


@query("SELECT p_partkey, 'n' || p_size % 4 AS slug, CASE WHEN p_size % 4 < 3 THEN 'theme ' || p_size % 4 END AS theme FROM part")
def framework_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments outside a framework beside the theme made of them, where there is one."""
    segments = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("n"), (F.col("p_size") % 4).cast("string")).alias("slug"))
    made = spark.createDataFrame([(f"n{i}", f"theme {i}") for i in range(3)], "slug string, theme string")
    return exports.framework_review(segments, made)


@query("SELECT 'framework_' || substr(sha256(n_name), 1, 16) || '.json' AS name FROM nation")
def archived_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a framework's file are named by their digest."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    return spark.createDataFrame([(exports.archive(r["n_name"].encode())[0],) for r in rows], "name string")


@query("SELECT unnest(['codes.csv', 'correlations.csv', 'run_metadata.json', 'sentiment_scores.csv', 'themes.json']) AS name, unnest([false, true, false, false, true]) AS missing")
def run_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a run's files are missing."""
    gone = exports.missing_artifacts(["codes.csv", "sentiment_scores.csv", "run_metadata.json", "other.txt"])
    return spark.createDataFrame([(n, n in gone) for n in exports.EXPECTED], "name string, missing boolean")


@query("SELECT '# methodology: two' AS stamp, n_nationkey AS id, n_name AS name FROM nation")
def stamped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's file under one line with its stamp, though it was stamped twice; readers leave the line out."""
    path = f"{scratch(spark, 'stamped')}/nation.csv"
    body = "id,name\n" + "".join(f"{r['n_nationkey']},{r['n_name']}\n" for r in table(spark, sf_dir, "nation").collect())  # 25 rows
    put(spark, path, exports.stamped_csv(exports.stamped_csv(body, "one"), "two"))
    stamp = spark.read.text(path).where("value LIKE '#%'").select(F.col("value").alias("stamp"))
    return stamp.crossJoin(spark.read.schema("id long, name string").option("header", "true").option("comment", "#").csv(path))


@query(ORACLES["theme_prevalence_detected"])
def prevalence_of_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence as the analysis gives it, from time stamps as text and a period that suits the span."""
    orders = table(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_orderkey").alias("std_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("std_timestamp"))
    pairs = orders.select(F.col("o_orderkey").alias("std_id"), F.col("o_orderpriority").alias("theme"))
    return analysis.over_time(entries, pairs)["prevalence"]


@query("SELECT l_returnflag AS run_id, l_linestatus AS code, count(*) AS n_runs FROM (SELECT DISTINCT l_returnflag, l_linestatus, year(l_shipdate) AS y FROM lineitem) GROUP BY ALL")
def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many runs each code is, study by study."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("code_text"), F.year("l_shipdate").cast("string").alias("run_id"))
    parts = [comparison.codes_across_runs(rows.where(F.col("l_returnflag") == f)).select(F.lit(f).alias("run_id"), F.upper("code").alias("code"), "n_runs") for f in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
