"""Exact duplicates by content sort, with DataFrame operations only.

Splitters are sampled from all rows, each by its share of the bytes, and range-partition the
rows into buckets by the start of the normalised bytes, a digest that orders texts of one
start, and doc_id.  Spark's external sort orders each bucket by the whole bytes, and every
text is compared in full with its neighbour: where they differ a run begins.  Splitters hold
a doc_id, so a text that a third of the rows have is cut into many buckets; its runs touch
the buckets' ends.  Such runs, at most a few a bucket, are sorted by content once more and
neighbours compared in full again, which joins them.  Equality is never read off a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import MOST_SENT, written

#: Characters of a text in a splitter; bytes of a bucket; buckets at most (beyond them buckets grow, and sorts spill); sampled rows a bucket.
HEAD, BUCKET_BYTES, MOST_BUCKETS, SAMPLED = 24, 64 << 20, 1 << 15, 12


def unchanged(text: Column) -> Column:
    return text


def _digest(text: Column) -> Column:
    """Orders texts of one start among each other; it need not tell them apart."""
    return F.xxhash64(text)


def _splitters(rows: DataFrame, buckets: int | None) -> DataFrame:
    """One row: the sorted array of splitters (head, digest, order), every SAMPLED-th of the sampled rows.

    A row is sampled by a hash of its key, with a chance in proportion to its bytes.
    """
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    if buckets is None:
        buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, total // BUCKET_BYTES))
    chance = F.pmod(F.xxhash64("digest", "order"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sampled = rows.where(chance < F.col("bytes").cast("double") * (buckets * SAMPLED / max(1, total)))
    keys = sampled.select(F.struct("head", "digest", "order").alias("key")).distinct().agg(F.sort_array(F.collect_list("key")).alias("keys"))
    places = F.filter(F.sequence(F.lit(0), F.size("keys")), lambda i: (i > 0) & (i % SAMPLED == 0))
    return keys.select(F.transform(places, lambda i: F.element_at("keys", i)).alias("splitters"))


def _bucket(key: Column, splitters: Column) -> Column:
    """How many splitters are not beyond the key, by binary search."""
    steps = F.array(*(F.lit(1 << b) for b in range(MOST_BUCKETS.bit_length(), -1, -1)))
    n = F.size(splitters)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.try_element_at(splitters, low + step) <= key), low + step).otherwise(low))


def _leads(text: Column, order: W) -> Column:
    """Whether a text differs from its neighbour, compared in full."""
    return ~F.lag(text).over(order).eqNullSafe(text)


def duplicates(docs: DataFrame, normalise=unchanged, keep: str = "min", buckets: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs`` (doc_id, text, anything else).

    Texts are equal when ``normalise`` gives the same bytes; null counts as empty.  Of equal
    texts the row with the smallest doc_id stays, or with ``keep="max"`` the largest.  Rows
    that repeat a doc_id count as rows of the group, and each carries the same answer.  A row
    without doc_id never stays while another has one; alone, or among its like, its keep_id is
    null and kept is true.  A very long text is one row of a bucket like any other.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.coalesce("text", F.lit(""))).alias("text"))
    # Rows that stay come first among their like; rows without doc_id last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), (F.col("doc_id") if keep == "min" else F.bitwise_not("doc_id")).alias("place"))
    rows = rows.select("doc_id", "text", F.substring("text", 1, HEAD).alias("head"), _digest(F.col("text")).alias("digest"), order.alias("order"))
    splitters = written(_splitters(rows.select("head", "digest", "order", (F.octet_length("text") + 16).alias("bytes")), buckets), "splitters")
    placed = rows.crossJoin(F.broadcast(splitters))  # one row, MOST_BUCKETS short keys at most
    placed = placed.withColumn("bucket", _bucket(F.struct("head", "digest", "order"), F.col("splitters")))
    key = F.struct("head", "digest")
    ends = (F.try_element_at("splitters", F.greatest(F.col("bucket"), F.lit(1))), F.try_element_at("splitters", F.col("bucket") + 1))
    at_end = F.coalesce(ends[0].dropFields("order") == key, F.lit(False)) | F.coalesce(ends[1].dropFields("order") == key, F.lit(False))
    dealt = placed.select("doc_id", "text", "head", "digest", "order", "bucket", at_end.alias("at_end"))

    content = W.partitionBy("bucket").orderBy("head", "digest", "text", "order")
    runs = dealt.withColumn("leads", _leads(F.col("text"), content))
    so_far = content.rowsBetween(W.unboundedPreceding, 0)
    runs = runs.select(
        "doc_id",
        "bucket",
        F.sum(F.col("leads").cast("int")).over(so_far).alias("run"),
        F.when(F.col("leads") & F.col("at_end"), F.struct("head", "digest", "text")).alias("edge"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )
    runs = written(runs, "runs")
    sizes = runs.groupBy("bucket", "run").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("edge").alias("edge"))
    sizes = written(sizes, "sizes")

    # Runs at the ends of buckets, sorted by content and compared with their neighbours once more.
    again = W.partitionBy("edge.head", "edge.digest").orderBy("edge.text", "bucket", "run")
    edges = sizes.where("edge IS NOT NULL").withColumn("leads", _leads(F.col("edge.text"), again))
    edges = edges.select("bucket", "run", "keep_id", "group_size", F.col("edge.head").alias("head"), F.col("edge.digest").alias("digest"), F.sum(F.col("leads").cast("int")).over(again.rowsBetween(W.unboundedPreceding, 0)).alias("whole"))
    wholes = edges.groupBy("head", "digest", "whole").agg(best("keep_id").alias("_keep"), F.sum("group_size").alias("_size"), F.count("*").alias("_runs")).where("_runs > 1")
    joined = written(edges.join(wholes, ["head", "digest", "whole"]).select("bucket", "run", "_keep", "_size"), "joined")
    found = sizes.drop("edge").join(F.broadcast(joined) if joined.count() <= MOST_SENT else joined, ["bucket", "run"], "left")
    found = found.select("bucket", "run", F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", "group_size").cast("long").alias("group_size"))
    return runs.join(found, ["bucket", "run"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, normalise=unchanged, keep: str = "min", buckets: int | None = None) -> DataFrame:
    """One row of each group of equal texts, in the columns of ``docs``; see :func:`duplicates`.

    Of rows that repeat both the doc_id and the text that stay, one stays.
    """
    found = written(duplicates(docs, normalise, keep, buckets), "duplicates")
    digest = F.sha2(F.encode(normalise(F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    gone = written(found.where("NOT kept").select("doc_id", "text_sha256").distinct(), "gone")
    again = written(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256"), "again")

    def of(table: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        right = table.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
        right = F.broadcast(right) if table.count() <= MOST_SENT // 8 else right
        return rows.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), how)

    left = of(gone, "left_anti", docs)
    if again.isEmpty():
        return left
    one = of(again, "left_semi", left).withColumn("_digest", digest).dropDuplicates(["doc_id", "_digest"]).drop("_digest")
    return of(again, "left_anti", left).unionByName(one)
