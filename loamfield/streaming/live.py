"""The engine's streams: prevalence as entries arrive, inserts without repeats, snapshots, sessions, and codebooks that grow.

Plans are those of the batch side where there is one; state is bounded by watermarks or by a
codebook.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema, files_a_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def prevalence(events: DataFrame, ts: str, theme: str, window: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, theme, n) per tumbling window, or sliding one with ``slide``; rows later than ``late`` are dropped, as a watermark must."""
    at = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(at.alias("w"), F.col(theme).alias("theme")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "theme", "n")


def sessions(events: DataFrame, ts: str, author: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(author, start, end, n): a contributor's entries without a gap between them."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(author).alias("author")).agg(F.count("*").alias("n")).select("author", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def inserts(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Rows appended to a Parquet table unless their key is there: a batch that is run again adds nothing.

    Of the table only the keys between a batch's least and greatest are read.
    """

    def put(rows: DataFrame, _: int) -> None:
        new = rows.dropDuplicates([key])
        ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
        try:
            stored = rows.sparkSession.read.schema(rows.schema).parquet(target).select(key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything but the first batch's missing table is an error
                raise
        else:
            if ends["a"] is not None:
                stored = stored.where(F.col(key).between(F.lit(ends["a"]), F.lit(ends["b"])))
            new = new.join(stored, key, "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(aggregate: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The whole state of an aggregate after each batch, each in a folder of its own number; the newest is the latest."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/snapshot={number:010d}")

    return aggregate.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def growing_codebook(coded: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(corpus, code_key, n, is_new) as segments (corpus, code_key) arrive: counts in state, one book a corpus."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        seen = set(counts)
        changed: dict[str, int] = {}
        for pdf in frames:
            for code, n in pdf["code_key"].value_counts().items():
                counts[code] = changed[code] = counts.get(code, 0) + int(n)
        state.update((list(counts), list(counts.values())))
        rows = sorted(changed.items())
        yield pd.DataFrame({corpus: [key[0]] * len(rows), "code_key": [c for c, _ in rows], "n": [n for _, n in rows], "is_new": [c not in seen for c, _ in rows]})

    kind = dict(coded.dtypes)[corpus]
    return coded.groupBy(corpus).applyInPandasWithState(update, f"{corpus} {kind}, code_key string, n long, is_new boolean", "codes array<string>, counts array<long>", "update", "NoTimeout")


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """A stream run over what is there, into a table in a shared folder; of a complete result the last state, else all changes."""
    spark, numbers = stream.sparkSession, []

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number:010d}")
        numbers.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = numbers[-1:] if mode == "complete" else numbers
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/batch={n:010d}" for n in kept))
