"""Passages that repeat across documents, found with a compressed FM-index per shard.

A passage is a window of ``window`` consecutive words that also starts in a document with a
smaller id.  Every window has an anchor, the smallest hash among its 20-word grams, so
equal windows have equal anchors; runs of windows with one anchor form a piece of some
66 words.  Pieces whose anchor occurs in one document only cannot repeat and are never moved.
The others are dealt to shards by anchor, equal pieces once.  A shard indexes its pieces
(:mod:`fm_index`) and streams them through the index by backward search over the wavelet
matrix, which reports for each window the smallest document that holds it.  The intervals go
back to every document that has the piece.

An anchor that more than ``CROWD`` different pieces share, such as a line that a third of the
documents have in other surroundings, would make one shard as large as the corpus.  Pieces of
such anchors are dealt anew by anchors of longer grams, and those still crowded by whole
windows, of which no two pieces of a shard differ: pieces that no other document shares drop
out at each step, the others are indexed and searched like any other, and what is found for a
part is found for its piece.

Words are compared by hashes: two windows are equal when the 32-bit codes of all their words
are, and the 64-bit hash of their anchor.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .hashing import U64, byte_view, gram_hashes, inverse, mix, pieces, powers, word_hashes
from .shared import chosen, lean, written

#: Words of the grams that anchors are chosen from, step by step; the last step takes whole windows.
ANCHORS = (20, 40)
#: Windows of one piece at most; a longer run of windows with one anchor is several pieces.
RUN = 64
#: Words after which a shard's task builds an index of what it has read; no anchor is divided.
INDEX_WORDS = 1 << 19
#: Different pieces of one anchor that a shard takes; more are dealt anew by longer grams.
CROWD = 256
_SPAN = 0xD6E8FEB86659FD93


def _grams(window: int) -> list[int]:
    """Lengths of the grams of anchors, step by step."""
    return [k for k in ANCHORS if k < window] + [window]


def _pieces_of(words: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and content hash of every piece of the texts with word offsets ``at``; anchors are of ``k`` words."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none.view(U64), none.view(U64)
    least, width = gram_hashes(words, k), window - k + 1
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    n = len(least)
    mark = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(at) >= window)
    np.add.at(mark, at[long], 1)
    np.add.at(mark, at[long + 1] - window + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    head = np.zeros(n, bool)
    head[1:] = least[1:] != least[:-1]
    head[at[long]] = True
    head &= valid
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(head, place, 0))
    head |= valid & (since % RUN == 0)
    first = np.flatnonzero(head)
    runs = np.add.reduceat(valid.astype(np.int64), first) if len(first) else none
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(_SPAN, len(words)), out=total[1:])
    content = (total[first + runs + window - 1] - total[first]) * powers(inverse(_SPAN), len(words))[first]
    return first, runs, least[first], mix(content + runs.astype(U64))


@lean
def _scanned(batches, window: int):
    """One row a document: its words, the digest of all of them, and its pieces."""
    for batch in batches:
        for part in pieces(batch, "text"):
            raw, offsets = byte_view(part.column("text"))
            words, _, at = word_hashes(raw, offsets)
            first, runs, anchors, contents = _pieces_of(words, at, window, _grams(window)[0])
            data, bounds = raw.tobytes(), offsets.tolist()
            digests = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = pa.array(np.searchsorted(first, at).astype(np.int32))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "mark": part.column("mark"),
                    "n_words": pa.array(np.diff(at)),
                    "digest": pa.array(digests),
                    "anchor": pa.ListArray.from_arrays(lists, pa.array(anchors.view(np.int64))),
                    "piece": pa.ListArray.from_arrays(lists, pa.array(contents.view(np.int64))),
                    "start": pa.ListArray.from_arrays(lists, pa.array((first - np.repeat(at[:-1], np.diff(lists.to_numpy()))).astype(np.int32))),
                    "runs": pa.ListArray.from_arrays(lists, pa.array(runs.astype(np.int32))),
                }
            )


@lean
def _contents(batches, window: int):
    """The words of the pieces that a document owns, as the low halves of their hashes."""
    for batch in batches:
        for part in pieces(batch, "text"):
            raw, offsets = byte_view(part.column("text"))
            words, _, at = word_hashes(raw, offsets)
            codes = (words & U64(0xFFFFFFFF)).astype(np.uint32)
            rows: dict[str, list] = {"anchor": [], "piece": [], "owner": [], "words": []}
            for i, (doc, owned) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("owned").to_pylist(), strict=True)):
                mine = codes[at[i] : at[i + 1]]
                for p in owned:
                    rows["anchor"].append(p["anchor"])
                    rows["piece"].append(p["piece"])
                    rows["owner"].append(doc)
                    rows["words"].append(mine[p["start"] : p["start"] + p["runs"] + window - 1].tobytes())
            kinds = {"anchor": pa.int64(), "piece": pa.int64(), "owner": pa.int64(), "words": pa.binary()}
            yield pa.record_batch({k: pa.array(v, kinds[k]) for k, v in rows.items()})


@lean
def _divided(batches, window: int, k: int):
    """Pieces by anchors of ``k`` words, with the piece that each is a part of and its first window there."""
    for batch in batches:
        texts = [np.frombuffer(w.as_buffer(), np.uint32) for w in batch.column("words")]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        first, runs, anchors, contents = _pieces_of(mix(codes.astype(U64)), at, window, k)
        of = np.searchsorted(at, first, "right") - 1
        yield pa.record_batch(
            {
                "anchor": pa.array(anchors.view(np.int64)),
                "piece": pa.array(contents.view(np.int64)),
                "parent": batch.column("piece").take(pa.array(of)),
                "offset": pa.array((first - at[of]).astype(np.int32)),
                "owner": batch.column("owner").take(pa.array(of)),
                "words": pa.array([codes[a : a + n + window - 1].tobytes() for a, n in zip(first.tolist(), runs.tolist(), strict=True)], pa.binary()),
            }
        )


def _reported(piece: list[int], owner: list[int], words: list[bytes], window: int) -> pa.RecordBatch:
    """Intervals of windows of each piece with the smallest document that holds them, from one index."""
    lengths = np.array([len(w) // 4 for w in words], np.int64)
    index = FMIndex(np.frombuffer(b"".join(words), np.uint32), lengths, np.array(owner, np.int64), window)
    least = index.matches()
    windows = lengths - window + 1
    of = np.repeat(np.arange(len(lengths)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    least = least[index.starts[of] + offset]
    head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])]))
    size = np.diff(np.append(head, len(of)))
    return pa.record_batch({"piece": pa.array(np.array(piece, np.int64)[of[head]]), "from": pa.array(offset[head].astype(np.int32)), "to": pa.array((offset[head] + size).astype(np.int32)), "least": pa.array(least[head])})


@lean
def _searched(batches, window: int):
    """Rows in order of their anchors; an index for every INDEX_WORDS words or so, and one at least for a whole anchor."""
    held: tuple[list, list, list] = ([], [], [])
    size, last = 0, None
    for batch in batches:
        for anchor, piece, owner, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "owner", "words")), strict=True):
            if size >= INDEX_WORDS and anchor != last:
                yield _reported(*held, window)
                held, size = ([], [], []), 0
            for to, x in zip(held, (piece, owner, words), strict=True):
                to.append(x)
            size, last = size + len(words) // 4, anchor
    if size:
        yield _reported(*held, window)


@lean
def _removed(batches, window: int):
    """Words left of each document, which windows to remove being given."""
    for batch in batches:
        for part in pieces(batch, "text"):
            texts = part.column("text").to_pylist()
            left, gone = [], []
            for text, hits in zip(texts, part.column("hits").to_pylist(), strict=True):
                words = (text or "").encode().split()
                drop = np.zeros(len(words) + 1, np.int32)
                for h in hits:
                    drop[h["from"]] += 1
                    drop[h["to"] + window - 1] -= 1
                drop = np.cumsum(drop)[:-1] > 0
                gone.append(int(drop.sum()))
                left.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d]).decode())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "n_words": pa.array([len((t or "").encode().split()) for t in texts], pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(left, pa.string())})


def _found(contents: DataFrame, window: int, grams: list[int]) -> DataFrame:
    """Intervals (piece, from, to, least) of the windows of ``contents`` (anchor, piece, owner, words), each piece once."""

    def searched(rows: DataFrame) -> DataFrame:
        return rows.select("anchor", "piece", "owner", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(functools.partial(_searched, window=window), "piece long, `from` int, `to` int, least long")

    if not grams:
        return searched(contents)
    crowds = written(contents.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("anchor"), "crowds")
    if crowds.isEmpty():
        return searched(contents)
    crowded = contents.join(crowds, "anchor", "left_semi")
    # Each window of a crowded piece is its owner's; its parts tell which are in earlier documents too.
    owns = crowded.select("piece", F.lit(0).alias("from"), (F.octet_length("words") / 4 - (window - 1)).cast("int").alias("to"), F.col("owner").alias("least"))
    parts = crowded.select("piece", "owner", "words").mapInArrow(functools.partial(_divided, window=window, k=grams[0]), "anchor long, piece long, parent long, offset int, owner long, words binary")
    parts = written(parts, "parts")
    shared = parts.groupBy("anchor").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("anchor")
    parts = written(parts.join(shared, "anchor", "left_semi"), "parts")
    firsts = parts.groupBy("anchor", "piece").agg(F.min(F.struct("owner", "words")).alias("o")).select("anchor", "piece", "o.owner", "o.words")
    inner = _found(written(firsts, "contents"), window, grams[1:])
    back = parts.select("piece", "parent", "offset", "owner").join(inner, "piece").where("least < owner")
    back = back.select(F.col("parent").alias("piece"), (F.col("offset") + F.col("from")).alias("from"), (F.col("offset") + F.col("to")).alias("to"), "least")
    # Intervals of a piece that touch and have one answer are one again, before documents meet them.
    order = W.partitionBy("piece", "least").orderBy("from", "to")
    islands = back.withColumn("island", F.col("from") > F.coalesce(F.lag("to").over(order), F.lit(-1))).withColumn("island", F.sum(F.col("island").cast("int")).over(order))
    joined = islands.groupBy("piece", "least", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).select("piece", "from", "to", "least")
    return searched(contents.join(crowds, "anchor", "left_anti")).unionByName(owns).unionByName(joined)


def repeated_passages(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """Two tables of ``docs`` (doc_id, text, anything else).

    The first has (doc_id, mark, n_words, digest) for each row: mark is a hash of its text,
    words are runs of bytes outside space and 0x09-0x0D, the digest is sha256 of all words
    joined by one space; a null or blank text has none.  The second has (doc_id, mark,
    n_words, n_removed, kept) once for each doc_id and text that may lose a word: each word covered by a ``window`` of words that also starts in a document
    with a smaller doc_id goes, ``kept`` is the rest joined by one space.  Windows are judged
    on the input.  Rows that share a doc_id are one document: their windows repeat no other
    of its rows, but each row loses only what is covered in its own text.  Rows without
    doc_id lose nothing and stand for nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    scanned = written(
        texts.mapInArrow(functools.partial(_scanned, window=window), "doc_id long, mark long, n_words long, digest string, anchor array<long>, piece array<long>, start array<int>, runs array<int>"),
        "scanned",
    )
    named = scanned.where("doc_id IS NOT NULL AND size(anchor) > 0")
    shared = (
        named.select("doc_id", F.explode(F.array_distinct("anchor")).alias("anchor"))
        .groupBy("anchor")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .select("anchor")
    )
    each = named.select("doc_id", "mark", F.explode(F.arrays_zip("anchor", "piece", "start", "runs")).alias("p")).select("doc_id", "mark", "p.*")
    members = written(each.join(shared, "anchor", "left_semi"), "members")
    owners = members.groupBy("anchor", "piece").agg(F.min(F.struct("doc_id", "mark", "start", "runs")).alias("o"))
    owners = written(owners.select("o.doc_id", "o.mark", "anchor", "piece", "o.start", "o.runs"), "owners")
    owned = owners.select("doc_id", "mark", F.struct("anchor", "piece", "start", "runs").alias("p"))
    owned = written(owned.groupBy("doc_id", "mark").agg(F.collect_list("p").alias("owned")), "owned")
    own = chosen(texts, owned.select("doc_id")).join(owned, ["doc_id", "mark"])
    contents = own.select("doc_id", "text", "owned").mapInArrow(functools.partial(_contents, window=window), "anchor long, piece long, owner long, words binary")
    found = _found(written(contents, "contents"), window, _grams(window)[1:])
    hits = (
        members.select("doc_id", "mark", "piece", "start")
        .join(found, "piece")
        .where("least < doc_id")
        .select("doc_id", "mark", F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to")).alias("hit"))
    )
    hits = written(hits.groupBy("doc_id", "mark").agg(F.collect_set("hit").alias("hits")), "hits")
    changed = chosen(texts, hits.select("doc_id")).join(hits, ["doc_id", "mark"]).select("doc_id", "mark", "text", "hits")
    changed = changed.mapInArrow(functools.partial(_removed, window=window), "doc_id long, mark long, n_words long, n_removed long, kept string")
    return scanned.select("doc_id", "mark", "n_words", "digest"), changed.dropDuplicates(["doc_id", "mark"])


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the words of repeated passages removed, in the columns of ``docs``.

    A changed text is the words left joined by one space, and n_chars, if there, its length;
    other rows stay as they are.  A document of which nothing is left goes.
    """
    _, changed = repeated_passages(docs, window)
    changed = written(changed, "changed").where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("kept").alias("_kept"))
    out = docs.join(changed, (docs["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_mark")), "left").where("_kept IS NULL OR _kept <> ''")
    new = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)
