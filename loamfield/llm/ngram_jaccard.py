"""Near-duplicate texts: an exact Jaccard join on distinct word n-grams.

Method: token-combination prefixes.  The tokens of a set are its n-gram hashes, in one total
order for the corpus: rare ones by class (of a count sketch over all documents) and hash, then
frequent ones by hash.  Sets similar enough share a token among their first ``p`` tokens.  If
the first token they share is rare, it is in the index: a set is listed under each rare token
of its prefix.  Else all they share is frequent, which only sets of mostly frequent tokens can
do; those are listed under combinations of two frequent tokens that follow each other in the
order.  Of ``o`` shared tokens, each token that is not shared parts at most one of the
``o - 1`` neighbours, so enough combinations are shared for a prefix of them, about two fifths
of the set at a similarity of 0.8: the index grows in proportion to a set of any size.  Each
entry keeps how many tokens may be shared from there on, and that and the size bound the
overlap before a pair is formed.

A list of the index may belong to thousands of copies.  Equal sets are one entry.  Of
unequal ones, every member is verified against the list's hub first; the components found so
far are then laid over the lists, and only pairs across components are verified.  That loses
no component: a pair left out is in one already.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import U64, mix, pieces, shingle_sets
from .shared import chosen, lean, passing, tidy, written

#: Bits of the least and of the largest sketch, bytes of text for each counter, and the count from which a token is called frequent.
SKETCH_BITS, MOST_BITS, BYTES_EACH, FREQUENT = 22, 25, 208, 256
_SLICE = 1 << 16
#: Tokens that a task counts at a time.
_RUN = 1 << 23


def sketch_bits(n_bytes: int) -> int:
    """The bits of the sketch for so much text: about 32 tokens a counter, within bounds."""
    return min(MOST_BITS, max(SKETCH_BITS, (-(-n_bytes // BYTES_EACH) - 1).bit_length()))


@lean
def _sketch(batches, n: int, bits: int):
    """Token counts of one task, as packed slices of bytes, wider ones where a count needs it."""
    held: list[np.ndarray] = []

    def counted():
        ids = np.concatenate(held)
        ids.sort()
        held.clear()
        cuts = np.searchsorted(ids, np.arange(0, (1 << bits) + 1, _SLICE))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = np.bincount(ids[cuts[k] : cuts[k + 1]] & np.uint32(_SLICE - 1), minlength=_SLICE)
            wide = bool(part.max() > 255)
            rows.append((k, wide, pa.compress(part.astype(np.uint32 if wide else np.uint8).tobytes(), codec="zstd", asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["slice", "wide", "counts"])

    size = 0
    for batch in batches:
        for part in pieces(batch, "text"):
            for s in shingle_sets(part.column("text"), n):
                if len(s):
                    held.append((s >> U64(64 - bits)).astype(np.uint32))
                    size += len(s)
            if size > _RUN:
                yield from counted()
                size = 0
    if held:
        yield from counted()


@lean
def _merged(batches):
    """Sums the slices of one id, in the order they come: one slice is held at a time."""
    held, total = None, None
    for batch in batches:
        for k, wide, packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "wide", "counts")), strict=True):
            if k != held:
                if held is not None:
                    yield _classes(held, total)
                held, total = k, np.zeros(_SLICE, np.uint64)
            kind = np.dtype(np.uint32 if wide else np.uint8)
            total += np.frombuffer(pa.decompress(packed, decompressed_size=_SLICE * kind.itemsize, codec="zstd", asbytes=True), kind)
    if held is not None:
        yield _classes(held, total)


def _classes(k: int, total: np.ndarray) -> pa.RecordBatch:
    """Classes of a slice's counts, less their median: what other tokens of a counter add to a token's count."""
    own = np.maximum(total.astype(np.float64) - np.median(total), 1)
    classes = np.ceil(np.log2(own) * 2).astype(np.uint8)
    return pa.record_batch({"slice": pa.array([k], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})


def token_classes(docs: DataFrame, n: int) -> np.ndarray:
    """Half-octave classes of the counts of tokens, by the top bits of the hash: 4 to 32 MB, by the size of the corpus."""
    bits = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    with tidy(docs.sparkSession):
        parts = docs.select("text").mapInArrow(functools.partial(_sketch, n=n, bits=bits), "slice int, wide boolean, counts binary")
        sums = parts.repartition(32, "slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice int, classes binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in sums:
        out[r["slice"] * _SLICE :][:_SLICE] = np.frombuffer(r["classes"], np.uint8)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def least_overlap(both: int, percent: int) -> int:
    """The smallest overlap of two sets with ``both`` tokens in all at that similarity."""
    return -(-percent * both // (100 + percent))


def least_shared(n: int, percent: int) -> int:
    """The fewest tokens that a set of ``n`` shares with any set of that similarity."""
    return (percent * n + 99) // 100


def least_combined(n: int, percent: int) -> int:
    """The fewest neighbouring pairs that a set of ``n`` tokens shares with any set of that similarity, if all they share is frequent."""
    o = least_shared(n, percent)
    return o - 1 - o * (100 - percent) // percent


def _entries(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one sorted set, and after how many of its tokens in order what is shared begins at the earliest."""
    n = len(s)
    c = classes[(s >> U64(65 - len(classes).bit_length())).astype(np.int64)]
    often = c >= 2 * np.log2(FREQUENT)
    order = np.argsort((np.where(often, 255, c).astype(U64) << U64(56)) | (s >> U64(8)), kind="stable")
    rare = n - int(often.sum())
    need, p = least_shared(n, percent), prefix_length(n, percent)
    # Partners too small, or a similarity too low, for a combination to be shared for certain: single tokens, whatever their class.
    alone = least_combined(need, percent) < 1
    at = np.arange(p if alone else min(p, rare))
    keys, places = [s[order[at]]], [at]
    if n - rare >= max(need, 2) and least_combined(100 * n // percent, percent) >= 1:
        g = s[often]
        combined = np.sort(mix(mix(g[:-1]) + g[1:] * U64(3)))[: len(g) - max(0, least_combined(n, percent))]
        keys.append(combined)
        places.append(np.full(len(combined), rare))
    return np.concatenate(keys), np.concatenate(places)


@lean
def _indexed(batches, n: int, percent: int, classes: Broadcast):
    """One row a document: size, digest of its set, and the entries of its prefix."""
    import hashlib

    for batch in batches:
        for part in pieces(batch, "text"):
            sizes, digests, keys, places = [], [], [], []
            for s in shingle_sets(part.column("text"), n):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                k, at = _entries(s, classes.value, percent) if len(s) else (s, s)
                keys.append(k.view(np.int64))
                places.append(at.astype(np.int32))
            lengths = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array(sizes, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "keys": pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(keys))),
                    "places": pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(places))),
                }
            )


@lean
def _sets(batches, n: int):
    for batch in batches:
        for part in pieces(batch, "text"):
            yield pa.record_batch({"id": part.column("doc_id"), "tokens": pa.array([s.tobytes() for s in shingle_sets(part.column("text"), n)], pa.binary())})


@lean
def _similar(batches, percent: int):
    """Of pairs with both sets, those whose Jaccard similarity is ``percent`` or more."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        keep = []
        for i in range(batch.num_rows):
            s, t = (np.frombuffer(c[i].as_buffer(), U64) for c in (x, y))
            both = np.concatenate([s, t])
            both.sort(kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= percent * (len(both) - shared))
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The links among distinct candidate pairs (a, b), checked on the whole sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = written(ids, "candidates")
    sets = written(chosen(texts, ids).mapInArrow(functools.partial(_sets, n=n), "id long, tokens binary"), "sets")
    x, y = (sets.select(F.col("id").alias(k), F.col("tokens").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(functools.partial(_similar, percent=percent), "a long, b long")


def similarity_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, anything else).

    Two documents are linked when their sets of distinct ``n``-word shingles have a Jaccard
    similarity of ``percent``/100 or more; component_id is the smallest doc_id reachable.
    A text of fewer words is one shingle; a null, empty or blank text has none and is linked
    with nothing.  Rows that share a doc_id are one document with several texts.  Rows
    without a doc_id are returned, with a null component.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(token_classes(texts, n))
    index = written(
        texts.mapInArrow(functools.partial(_indexed, n=n, percent=percent, classes=classes), "doc_id long, n long, digest binary, keys array<long>, places array<int>"),
        "index",
    )
    named = index.where("doc_id IS NOT NULL AND n > 0")
    least = named.groupBy("digest").agg(F.min("doc_id").alias("first"))
    members = named.select("doc_id", "digest").join(least, "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    firsts = named.select("doc_id", "n", "digest", "keys", "places").join(least, (F.col("doc_id") == F.col("first")) & (named["digest"] == least["digest"]), "left_semi")
    entries = firsts.select("doc_id", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("keys", "places")).alias("e")).select(
        "doc_id", "n", F.col("e.keys").alias("token"), F.col("e.places").alias("at")
    )
    hubs = entries.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("at", "n", "doc_id")).alias("hub")).where("df > 1")

    def may_reach(n1, at1, n2, at2):
        need = F.ceil((n1 + n2) * percent / F.lit(100.0 + percent) - 1e-9)
        return F.least(n1 - at1, n2 - at2) >= need

    with passing(spark):
        with passing(spark):
            # Written, as other sums by token below, so that their joins shuffle both sides and Spark can split a list that many are in.
            hubs = written(hubs.select("token", "hub"), "hubs")
            shared = written(entries.join(hubs, "token"), "lists", lasting=True)
        hub = F.col("hub")
        pairs = (
            shared.where((F.col("doc_id") != hub["doc_id"]) & may_reach(F.col("n"), F.col("at"), hub["n"], hub["at"]))
            .select(F.greatest("doc_id", hub["doc_id"]).alias("a"), F.least("doc_id", hub["doc_id"]).alias("b"))
            .distinct()
        )
        pairs = written(pairs, "pairs")
        with passing(spark):
            links = written(_verified(pairs, texts, n, percent), "verified")
            known = written(components(links), "components", lasting=True)

        # Pairs across components: of each list, what lies outside the component most of it is in, against all of it.
        placed = shared.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", "at", F.coalesce("component", "doc_id").alias("c"), F.col("hub.doc_id").alias("h"))
        with passing(spark):
            split = placed.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("token")
            split = written(split, "split")
            open_ = written(placed.join(split, "token", "left_semi"), "open", lasting=True)
        largest = open_.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c")).alias("top")).select("token", F.col("top.c").alias("top"))
        largest = written(largest, "largest")
        minor = open_.where("doc_id <> h").join(largest, "token").where("c <> top").select("token", *(F.col(c).alias(f"{c}_") for c in ("doc_id", "n", "at", "c")))
        rest = (
            minor.join(open_.where("doc_id <> h"), "token")
            .where((F.col("c") != F.col("c_")) & may_reach(F.col("n"), F.col("at"), F.col("n_"), F.col("at_")))
            .select(F.greatest("doc_id", "doc_id_").alias("a"), F.least("doc_id", "doc_id_").alias("b"))
            .distinct()
        )
        rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = _verified(rest, texts, n, percent)
        links = written(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(members), "links", lasting=True)
        final = written(components(links), "components", lasting=True)
    return index.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id; rows without doc_id stay."""
    found = similarity_components(docs, n, percent)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return chosen(docs, gone, "left_anti")
