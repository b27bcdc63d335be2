"""Tables brought to one schema of entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables taken as a corpus by name, names of columns by kind of source, internal columns.
CORPUS_TABLES = ("posts", "comments", "submissions", "data", "entries", "corpus", "texts")
COLUMNS: Mapping[str, Mapping[str, Sequence[str]]] = {
    "reddit": {"id": ("post_id", "comment_id", "submission_id", "id"), "text": ("text", "body", "comment_body", "selftext", "content"), "author": ("author", "username", "user"), "timestamp": ("created_utc", "timestamp", "created_at", "date")},
    "twitter": {"id": ("tweet_id", "id"), "text": ("text", "tweet", "full_text", "content"), "author": ("author", "username", "user", "screen_name"), "timestamp": ("created_at", "timestamp", "date")},
    "survey": {"id": ("response_id", "respondent_id", "id"), "text": ("response", "answer", "text", "comment"), "author": ("respondent_id", "participant", "author"), "timestamp": ("submitted_at", "timestamp", "date")},
    "generic": {"id": ("id", "doc_id", "entry_id", "event_id", "std_id"), "text": ("text", "body", "content", "message", "comment"), "author": ("author", "user", "user_id", "username", "source"), "timestamp": ("timestamp", "ts", "created_at", "date", "time")},
}
STANDARD = ("std_id", "std_text", "std_author", "std_timestamp", "original_text")
INTERNAL = (*STANDARD, "std_ts", "row_ord", "source_table", "sentiment_score", "confidence", "emotion_intensity", "all_emotions", "emerged_themes", "subtheme_assignments")
MEMBERSHIP = "theme_membership_"


def explored(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_columns, n_rows, columns) of each table; a count each."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), F.count("*").alias("n_rows"), F.lit(", ".join(df.columns)).alias("columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def picked_table(tables: Mapping[str, DataFrame]) -> str:
    """The first table, in the order given, with a corpus's name; else the one with most rows."""
    named = next((t for t in tables if t.lower() in CORPUS_TABLES), None)
    if named or not tables:
        return named or ""
    counts = {t: df.count() for t, df in tables.items()}
    return max(counts, key=lambda t: counts[t])


def loaded(spark: SparkSession, tables: Mapping[str, DataFrame], table: str | None = None, query: str | None = None) -> DataFrame:
    """A query's result, the named table, or the one picked."""
    if query:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)
    return tables[table or picked_table(tables)]


def detected_columns(columns: Sequence[str], source_type: str = "generic", mapping: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """The column for id, text, author and timestamp: as mapped, else the first known name, in any case.

    Without a text column that is an error; any other may be missing.
    """
    by_lower = {c.lower(): c for c in reversed(columns)}
    out: dict[str, str | None] = {}
    for kind, names in COLUMNS.get(source_type, COLUMNS["generic"]).items():
        given = (mapping or {}).get(kind)
        if given is not None and given not in columns:
            raise ValueError(f"there is no column {given}")
        out[kind] = given or next((by_lower[n] for n in names if n in by_lower), None)
    if not out["text"]:
        raise ValueError("there is no column of texts")
    return out


def standardised(df: DataFrame, columns: Mapping[str, str | None], order: Sequence[str] = (), table: str | None = None) -> DataFrame:
    """Entries: std_id, std_text, std_author, std_timestamp, original_text as text, row_ord, and numeric metrics as doubles.

    Without an id column rows are numbered.  row_ord follows ``order`` (the id without one).
    A numeric time whose first value is an epoch in seconds becomes ISO text in UTC.
    """
    cid, text, author, ts = (columns.get(k) for k in ("id", "text", "author", "timestamp"))
    by = [*order] or ([cid] if cid else [text])
    rows = df.withColumn("row_ord", ranked_by(df, by))
    none = F.lit(None).cast("string")
    stamp = F.col(ts).cast("string") if ts else none
    if ts and isinstance(df.schema[ts].dataType, T.NumericType):
        first = rows.where(F.col(ts).isNotNull()).agg(F.min_by(F.col(ts).cast("double"), "row_ord").alias("v")).first()["v"]
        if first is not None and 1e9 < first < 2e10:
            stamp = F.date_format(F.timestamp_seconds(F.col(ts)), "yyyy-MM-dd HH:mm:ss")
    used = {c for c in (cid, text, author, ts) if c}
    metrics = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in used and f.name not in INTERNAL]
    return rows.select(
        (F.col(cid) if cid else F.col("row_ord")).cast("string").alias("std_id"),
        F.col(text).cast("string").alias("std_text"),
        (F.col(author).cast("string") if author else none).alias("std_author"),
        stamp.alias("std_timestamp"),
        F.col(text).cast("string").alias("original_text"),
        "row_ord",
        *(F.col(m).cast("double").alias(m) for m in metrics),
        *([F.lit(table).alias("source_table")] if table else []),
    )


def ranked_by(df: DataFrame, by: Sequence[str]):
    """A sortable stand-in for the order of rows: the key itself where it is a whole number, else a hash of it with no window over the table."""
    if len(by) == 1 and isinstance(df.schema[by[0]].dataType, (T.LongType, T.IntegerType)):
        return F.col(by[0]).cast("long")
    return F.xxhash64(*by)


def combined(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Entries of several tables, by column name with nulls for missing metrics.

    If any id occurs twice, every id takes its table's name before it; if some still do, that
    is an error.  Empty tables are left out.
    """
    rows = None
    for name, df in parts.items():
        if df.isEmpty():
            continue
        df = df.withColumn("source_table", F.lit(name))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    if rows is None:
        raise ValueError("all tables are empty")
    if repeated(rows, "std_id").isEmpty():
        return rows
    rows = rows.withColumn("std_id", F.concat_ws(":", "source_table", "std_id"))
    if not repeated(rows, "std_id").isEmpty():
        raise ValueError("ids repeat within a table")
    return rows


def prefixed(rows: DataFrame, table: str, key: str) -> DataFrame:
    return rows.withColumn(key, F.concat_ws(":", F.col(table), F.col(key).cast("string")))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def metric_columns(df: DataFrame, explicit: Sequence[str] | None = None, configured: Sequence[str] | None = None) -> list[str]:
    """Numeric columns to describe: those asked for, else configured, else all that aren't internal."""
    chosen = explicit or configured
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if chosen:
        return [c for c in chosen if c in numeric]
    return [c for c in numeric if c not in INTERNAL and not c.startswith(MEMBERSHIP)]


def first_of_each(rows: DataFrame, key: str, order: str = "row_ord") -> DataFrame:
    """Of rows with equal keys the first in order.  Aggregated before it is shuffled, so copies of one key don't meet in one task."""
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("_r"))
    return kept.select(*(key if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns))


def inserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't stored yet, one of each key."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def backfill(posts: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """Posts that no comment was stored for."""
    return posts.join(comments.select(key), key, "left_anti")


COMMENT_GONE = ("[deleted]", "[removed]")


def flattened_threads(rows: DataFrame, node: str, parent: str, text: str, most_depth: int = 50) -> DataFrame:
    """(node, root, depth, path) of threads level by level from their roots, rows whose text is gone left out with what is below.

    Ends when a level is empty or at ``most_depth``.
    """
    kept = rows.where(~F.coalesce(F.col(text), F.lit("")).isin(*COMMENT_GONE)).select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    level = kept.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = level
    for _ in range(most_depth):
        level = kept.alias("k").join(level.alias("l"), F.col("k.parent") == F.col("l.node")).select(F.col("k.node").alias("node"), "l.root", (F.col("l.depth") + 1).alias("depth"), F.concat("l.path", F.array("k.node")).alias("path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def expanded(start: DataFrame, links: DataFrame, most_rounds: int = 12) -> DataFrame:
    """Ids reachable from ``start`` (id) over ``links`` (id, next): a fixpoint that looks at each id once."""
    seen = start.select("id").distinct()
    front = seen
    for _ in range(most_rounds):
        front = links.join(front, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def sampled_entries(entries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A test's sample: ``n`` entries by a digest of seed and id, in their own order."""
    return entries.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("std_id")).cast("binary")), "std_id").limit(n).orderBy("row_ord")


def numbered(rows: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("row_no", F.row_number().over(W.partitionBy(*by or [F.lit(0)]).orderBy(order)))
