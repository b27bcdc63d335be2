"""Results as files: tables by theme, nested themes, projects for other tools, stamps and checkpoints.

Tables of entries are written by executors and partitioned where they are large; only files
whose format is one document (JSON cards, project archives) are made on the driver, from rows
that are a codebook's.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Files that a run leaves, steps and types of a log.
EXPECTED = ("sentiment_scores.csv", "codes.csv", "correlations.csv", "themes.json", "run_metadata.json")
LOG_STEPS = ("coding", "sentiment", "themes", "correlation", "review", "report")
LOG_TYPES = ("new_code", "assign_code", "merge", "skip", "theme", "request", "fabrication")
STAMP = "# methodology: "


def flat(df: DataFrame) -> DataFrame:
    """Arrays of text joined by ``"; "``, other nested columns as JSON, for files of plain columns."""
    return df.select(*(F.array_join(f"`{c}`", "; ").alias(c) if t == "array<string>" else F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes))


#: Texts stay as they are: quotes doubled, white space at either end kept.
_PLAIN = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, also when there are no rows; ``one_file`` only for tables of result size."""
    rows = flat(df)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").options(**_PLAIN).csv(path)


def entries_by_theme(entries: DataFrame, membership: DataFrame, path: str) -> None:
    """Entries in a folder for each theme; an entry is in each of its themes' folders."""
    flat(entries.join(membership.select("std_id", "theme"), "std_id")).write.mode("overwrite").partitionBy("theme").options(**_PLAIN).csv(path)


def subtheme_summary(stats: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row for each theme and subtheme from long rows (theme, subtheme, metric, median, mad, mean, sd, n)."""
    return stats.groupBy("theme", "subtheme").pivot("metric", list(metrics)).agg(F.first("median").alias("median"), F.first("mad").alias("mad"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.first("n").alias("n"))


def nested_themes(themes: DataFrame, codes: DataFrame) -> DataFrame:
    """(json) one theme a row with its codes, for a file of JSON lines."""
    inner = codes.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("code_key", "frequency"))).alias("codes"))
    return themes.join(inner, "theme", "left").select(F.to_json(F.struct(*themes.columns, "codes")).alias("json"))


def stamped_json(payload: object, stamp: dict) -> str:
    """A payload in its stamp's envelope; one in an envelope already gets the new stamp only."""
    if isinstance(payload, dict) and set(payload) == {"_methodology_stamp", "_payload"}:
        payload = payload["_payload"]
    return json.dumps({"_methodology_stamp": stamp, "_payload": payload}, ensure_ascii=False)


def stamped_csv(text: str, stamp: str) -> str:
    """CSV text under one line with its stamp, whatever lines of the kind it had."""
    body = "".join(x for x in text.splitlines(keepends=True) if not x.startswith(STAMP))
    return f"{STAMP}{stamp}\n{body}"


def log_rows(rows: DataFrame) -> DataFrame:
    """Rows of a log as JSON lines; a step or type that isn't listed is an error for the row's job."""
    known = F.col("step").isin(*LOG_STEPS) & F.col("decision_type").isin(*LOG_TYPES)
    checked = F.when(known, F.to_json(F.struct(*rows.columns))).otherwise(F.raise_error(F.lit("unknown step or type of a log")))
    return rows.select(checked.alias("value"))


def appended_log(rows: DataFrame, path: str) -> None:
    log_rows(rows).write.mode("append").text(path)


def fabricated_only(quotes: DataFrame) -> DataFrame:
    return quotes.where("status = 'fabricated'")


def framework_review(segments: DataFrame, emergent: DataFrame) -> DataFrame:
    """Segments outside a framework beside the theme and code made of them."""
    return segments.join(emergent, "slug", "left").select(*segments.columns, *(c for c in emergent.columns if c != "slug"))


def missing_artifacts(present: Sequence[str], expected: Sequence[str] = EXPECTED) -> list[str]:
    return sorted(set(expected) - set(present))


def archive(spec: bytes) -> tuple[str, bytes]:
    """A copy's name by its digest, and the bytes."""
    return f"framework_{hashlib.sha256(spec).hexdigest()[:16]}.json", spec


def _guid(*parts: object) -> str:
    h = hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def qdpx(entries: DataFrame, segments: DataFrame, codes: DataFrame, name: str = "project", most: int = 50_000) -> bytes:
    """A REFI-QDA project of codes (code_key, name), entries (std_id, std_text) and segments (std_id, code_key, start_char, end_char).

    A project is one file that a person opens; more than ``most`` entries are an error, not cut.
    """
    rows = entries.select("std_id", "std_text").orderBy("std_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a project has at most {most} entries")
    by: dict[str, list] = {}
    for s in segments.select("std_id", "code_key", "start_char", "end_char").orderBy("std_id", "start_char", "code_key").toLocalIterator():
        by.setdefault(str(s["std_id"]), []).append(s)
    book = codes.select("code_key", "name").orderBy("code_key").collect()
    xml = ['<?xml version="1.0" encoding="utf-8"?>', f'<Project xmlns="urn:QDA-XML:project:1.0" name={quoteattr(name)} origin="loamfield">', "<CodeBook><Codes>"]
    xml += [f'<Code guid="{_guid("code", c["code_key"])}" name={quoteattr(c["name"] or c["code_key"])} isCodable="true"/>' for c in book]
    xml.append("</Codes></CodeBook><Sources>")
    for r in rows:
        source = _guid("source", r["std_id"])
        xml.append(f'<TextSource guid="{source}" name={quoteattr(str(r["std_id"]))}><PlainTextContent>{escape("".join(c for c in r["std_text"] or "" if c >= " " or c in chr(9) + chr(10) + chr(13)))}</PlainTextContent>')
        for i, s in enumerate(by.get(str(r["std_id"]), ())):
            xml.append(f'<PlainTextSelection guid="{_guid(source, i)}" startPosition="{s["start_char"]}" endPosition="{s["end_char"]}"><Coding guid="{_guid(source, i, "c")}"><CodeRef targetGUID="{_guid("code", s["code_key"])}"/></Coding></PlainTextSelection>')
        xml.append("</TextSource>")
    xml.append("</Sources></Project>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("project.qde", "\n".join(xml))
    return out.getvalue()


def checkpoint(df: DataFrame, folder: str, step: str, partial: bool = False) -> None:
    """A step's table; a full one takes the place of the partial one."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{step}.{'partial' if partial else 'full'}")
    if not partial:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{step}.partial")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def coverage_card(row: DataFrame) -> str:
    """The one row of a coverage table as JSON."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("j")).first()["j"]
