"""Texts of manuscripts and raw documents: docx, txt and md files, cut into sections."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sections by the headings that open them, in order.
SECTIONS = (
    ("abstract", r"(?i)^#*\s*(\d+\.?\s*)?abstract\b"),
    ("introduction", r"(?i)^#*\s*(\d+\.?\s*)?(introduction|background)\b"),
    ("methods", r"(?i)^#*\s*(\d+\.?\s*)?(methods?|methodology|materials and methods)\b"),
    ("results", r"(?i)^#*\s*(\d+\.?\s*)?(results|findings)\b"),
    ("discussion", r"(?i)^#*\s*(\d+\.?\s*)?discussion\b"),
    ("conclusion", r"(?i)^#*\s*(\d+\.?\s*)?(conclusions?|limitations)\b"),
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a docx file, a line each; None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


@F.pandas_udf(T.StringType())
def _text(paths: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([docx_text(c) if p.lower().endswith(".docx") else bytes(c).decode("utf-8", "replace") for p, c in zip(paths, contents, strict=True)])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the docx, txt and md files below a folder, read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,txt,md}").load(folder)
    return files.select("path", _text("path", "content").alias("text"))


def sections(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, section, text): lines gathered under the last heading above them; a repeated section is joined on."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    opens = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        opens = F.when((F.char_length("line") < 80) & F.col("line").rlike(pattern), name).otherwise(opens)
    marked = lines.withColumn("_opens", opens).withColumn("section", F.last("_opens", ignorenulls=True).over(W.partitionBy(key).orderBy("i")))
    body = marked.where("section IS NOT NULL AND _opens IS NULL")
    return body.groupBy(key, "section").agg(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n"), F.lit(" \t\r\n")).alias("text"))


def filename_metadata(name: Column) -> dict[str, Column]:
    """Date, user, rating and likes that a file's name holds; ``N.A.`` and what is missing are null."""
    part = lambda pattern: F.nullif(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit("N.A."))
    return {
        "date": part(r"(\d{4}-\d{2}-\d{2})"),
        "username": part(r"(?i)user[_-]([A-Za-z0-9.]+)"),
        "rating": part(r"(?i)rating[_-]([0-9.]+|N\.A\.)").try_cast("double"),
        "likes": part(r"(?i)likes[_-]([0-9]+|N\.A\.)").try_cast("int"),
    }


RUN_FOLDER = re.compile(r"run_\d{4}-\d{2}-\d{2}_\d{6}(_M[123])?")
