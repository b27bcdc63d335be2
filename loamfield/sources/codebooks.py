"""Codebooks of four tools in one table: code, description, parent, group, frequency, level.

Files of a study are small and are read on the driver with the standard library (xlsx and
qdpx are zipped XML); the tables made of them are frames.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import indent_parents, path_levels

SCHEMA = "code string, description string, parent string, grp string, frequency long, line long"
# Names of columns by tool; a tool is known by a column that only it has.
ALIASES: Mapping[str, Mapping[str, Sequence[str]]] = {
    "nvivo": {"code": ("name", "node"), "description": ("description", "nickname"), "parent": ("parent name", "hierarchical name", "folder"), "frequency": ("references", "number of coding references", "coding references")},
    "atlasti": {"code": ("code", "code name"), "description": ("comment", "code comment"), "group": ("code group", "code groups", "groups", "code group 1"), "frequency": ("grounded", "groundedness", "density")},
    "maxqda": {"code": ("code", "code system"), "description": ("memo", "code memo"), "parent": ("parent code", "parent"), "frequency": ("coded segments", "frequency", "cod. seg. (all documents)")},
    "generic": {"code": ("code", "name", "theme", "label", "category"), "description": ("description", "definition", "notes", "comment"), "parent": ("parent", "parent code", "category", "group"), "frequency": ("frequency", "count", "n", "references")},
}
MARKS = (("nvivo", ("hierarchical name", "nickname", "number of coding references")), ("atlasti", ("grounded", "groundedness", "code group 1", "code groups")), ("maxqda", ("code system", "coded segments", "cod. seg. (all documents)")))
_NS = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "q": "urn:QDA-XML:project:1.0"}


def tool_of(columns: Sequence[str]) -> str:
    names = {c.strip().lower() for c in columns}
    return next((tool for tool, marks in MARKS if names & set(marks)), "generic")


def csv_rows(data: bytes) -> list[dict[str, str]]:
    return list(csv.DictReader(io.StringIO(data.decode("utf-8-sig"))))


def xlsx_rows(data: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet by its first row's names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['s']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("s:si", _NS)]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
    table = []
    for row in sheet.iter(f"{{{_NS['s']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("s:c", _NS):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            v = c.find("s:v", _NS)
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['s']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
            cells[at - 1 if letters else len(cells)] = shared[int(text)] if c.get("t") == "s" and text else text
        table.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    if not table:
        return []
    return [dict(zip(table[0], r + [""] * len(table[0]), strict=False)) for r in table[1:]]


def codebook(spark: SparkSession, rows: list[dict[str, str]], tool: str | None = None) -> DataFrame:
    """A codebook's rows under the common names, with parents and levels inferred."""
    tool = tool or tool_of(list(rows[0]) if rows else [])
    alias = ALIASES[tool]

    def value(row: dict[str, str], kind: str) -> str | None:
        by = {k.strip().lower(): v for k, v in row.items() if k}
        return next((by[n] for n in alias.get(kind, ()) if by.get(n)), None)

    out = []
    for i, r in enumerate(rows):
        code, parent, group = value(r, "code"), value(r, "parent"), value(r, "group")
        if code is None:
            continue
        if tool == "atlasti" and not group and ": " in code:
            group, code = code.split(": ", 1)
        number = re.sub(r"[^0-9]", "", value(r, "frequency") or "")
        out.append((code, value(r, "description"), parent or group, group, int(number) if number else None, i))
    return with_hierarchy(spark.createDataFrame(out, SCHEMA))


def with_hierarchy(book: DataFrame) -> DataFrame:
    """``book`` with code, parent and level from a parent column, a path in the name, or the indent of lines, whichever a line has."""
    parts = path_levels(F.col("code"))
    indent = F.floor((F.char_length("code") - F.char_length(F.ltrim("code"))) / 2) + 1
    rows = book.withColumns({"_parts": parts, "_level": indent.cast("int"), "_name": F.trim(F.element_at(parts, -1)), "_book": F.lit(0)})
    rows = indent_parents(rows.withColumnRenamed("parent", "_given"), "_book", "line", "_level", "_name").withColumnRenamed("parent", "_above")
    by_path = F.when(F.size("_parts") > 1, F.element_at("_parts", -2))
    by_indent = F.when(F.col("_level") > 1, F.col("_above"))
    parent = F.coalesce(F.nullif(F.trim("_given"), F.lit("")), by_path, by_indent)
    level = F.when(F.size("_parts") > 1, F.size("_parts")).when(F.col("_level") > 1, F.col("_level")).when(parent.isNotNull(), 2).otherwise(1)
    return rows.select(F.col("_name").alias("code"), "description", parent.alias("parent"), "grp", "frequency", level.alias("level"), "line")


def qdpx(spark: SparkSession, data: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes (guid, name, parent_guid, path), sources (source, text) and references (source, code, start, end) of a REFI-QDA project."""
    codes, sources, refs = [], [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read(next(n for n in z.namelist() if n.endswith(".qde"))))

        def walk(node, parent: str | None, path: list[str]) -> None:
            for c in node.findall("q:Code", _NS):
                here = [*path, c.get("name", "")]
                codes.append((c.get("guid"), c.get("name"), parent, here))
                walk(c, c.get("guid"), here)

        for group in root.iter(f"{{{_NS['q']}}}Codes"):
            walk(group, None, [])
        for s in root.iter(f"{{{_NS['q']}}}TextSource"):
            inner = s.find("q:PlainTextContent", _NS)
            path = (s.get("plainTextPath") or "").replace("internal://", "sources/")
            text = inner.text if inner is not None else z.read(path).decode("utf-8", "replace") if path in z.namelist() else None
            sources.append((s.get("guid"), s.get("name"), text))
            for sel in s.findall("q:PlainTextSelection", _NS):
                for coding in sel.iter(f"{{{_NS['q']}}}CodeRef"):
                    refs.append((s.get("guid"), coding.get("targetGUID"), int(sel.get("startPosition", 0)), int(sel.get("endPosition", 0))))
    return (
        spark.createDataFrame(codes, "guid string, name string, parent_guid string, path array<string>"),
        spark.createDataFrame(sources, "source string, name string, text string"),
        spark.createDataFrame(refs, "source string, guid string, start_char int, end_char int"),
    )


def coding_benchmarks(codings: DataFrame) -> DataFrame:
    """One row a study of (study, code, source, n_chars, source_chars): counts, frequency quantiles, lengths and coverage."""
    by_code = codings.groupBy("study", "code").agg(F.count("*").alias("k"))
    q = F.percentile("k", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))))
    per_code = by_code.groupBy("study").agg(F.count("*").alias("n_codes"), q.alias("_q")).select("study", "n_codes", *(F.col("_q")[i].alias(f"frequency_{n}") for i, n in enumerate(("p25", "p50", "p75", "p90"))))
    by_source = codings.groupBy("study", "source").agg((100 * F.sum("n_chars") / F.max("source_chars")).alias("pct"))
    per_source = by_source.groupBy("study").agg(F.count("*").alias("n_sources"), F.max("pct").alias("max_coverage"), F.percentile("pct", F.lit(0.5)).alias("median_coverage"))
    segments = codings.groupBy("study").agg(F.count("*").alias("n_segments"), F.avg("n_chars").alias("mean_length"), F.percentile("n_chars", F.lit(0.5)).alias("median_length"))
    return segments.join(per_code, "study").join(per_source, "study")
