"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is the counts of its words, its byte trigrams, the trigrams of its character kinds and
its repetitions, hashed into ``FEATURES`` bins, damped and weighted by rarity; a truncated singular value decomposition of the labelled
texts gives ``DIMENSIONS`` latent axes.  The labelled vectors, at most ``most_labelled`` of
them, go to every executor; each document's cosine with all of them is computed exactly, in
blocks, and the ``NEIGHBOURS`` nearest vote with their similarity as weight.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U64, byte_view, mix, pieces, word_hashes
from .shared import lean, released

#: Bins of trigrams of character kinds, of repetitions, of words and of byte trigrams.
KINDS, REPEATS, TERMS, GRAMS = 512, 32, 1024, 480
FEATURES, DIMENSIONS, NEIGHBOURS = KINDS + REPEATS + TERMS + GRAMS, 48, 25
_BLOCKS = [slice(a, a + n) for a, n in zip(np.cumsum([0, KINDS, REPEATS, TERMS]).tolist(), (KINDS, REPEATS, TERMS, GRAMS), strict=True)]
#: Labelled rows that the model is made from, at most: those with the smallest hashes of their ids.
MOST_LABELLED = 8192
#: Similarities weigh by this power, so that near neighbours count for more.
SHARPNESS = 8
#: Similarities are told apart in steps of this fraction: far above the rounding of sums, far below what matters.
STEPS = 1 << 30
#: Steps towards the latent axes.
ITERATIONS = 40
#: Texts whose similarities with all voters are held at a time.
BLOCK = 128

_KIND = np.zeros(256, np.uint64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 1
_KIND[[0x20, 9, 10, 11, 12, 13]] = 4
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 5 + _i
_KIND[0x0A] = 40
_KIND_BIN = (mix(np.arange(64**3, dtype=U64)) % U64(KINDS)).astype(np.int64)

#: Bytes with A-Z lower-cased and white space alike.
_FOLDED = np.arange(256, dtype=U64)
_FOLDED[ord("A") : ord("Z") + 1] += U64(32)
_FOLDED[[9, 10, 11, 12, 13]] = 0x20


def _trigrams(codes: np.ndarray, heads: np.ndarray, base: int) -> np.ndarray:
    """Each code with the two before it in its text, as digits of ``base``."""
    before = np.zeros((2, len(codes)), U64)
    for last, of in ((codes, before[0]), (before[0], before[1])):
        of[1:] = last[:-1]
        of[heads] = 0  # what stands before a text is no part of it
    return codes + before[0] * U64(base) + before[1] * U64(base * base)


def features(texts: pa.Array) -> np.ndarray:
    """Weights of the features of each text before rarity: rows of FEATURES floats.

    The bins hold, one block after another: trigrams of character kinds (letters, capitals,
    digits, space and each punctuation mark); how often each word has come already in the
    text and whether it is the same word again, which repetition shifts; words, A-Z
    lower-cased; and trigrams of bytes, A-Z lower-cased, which tell scripts without spaces.
    """
    raw, offsets = byte_view(texts)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        return out
    kinds, repeats, terms, grams = _BLOCKS

    def count(block: slice, owner: np.ndarray, bins: np.ndarray) -> None:
        size = block.stop - block.start
        out[:, block] = np.bincount(owner * size + bins, minlength=n * size).reshape(n, size)

    heads = offsets[:-1][offsets[:-1] < len(raw)]
    row = np.repeat(np.arange(n), np.diff(offsets))
    count(kinds, row, _KIND_BIN[_trigrams(_KIND[raw], heads, 64).astype(np.int64)])
    count(grams, row, (mix(_trigrams(_FOLDED[raw], heads, 256)) % U64(GRAMS)).astype(np.int64))
    words, _, at = word_hashes(raw, offsets, True)
    if len(words):
        owner = np.repeat(np.arange(n), np.diff(at))
        key = words ^ mix(owner.astype(U64))
        order = np.argsort(key, kind="stable")
        s = key[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times = np.empty(len(s), np.int64)
        times[order] = np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))
        share = np.minimum(np.log2(times + 1).astype(np.int64), 15)
        # The same word again at once, and the same step between words, are told apart from a common word.
        again = np.zeros(len(words), np.int64)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        count(repeats, owner, share * 2 + again)
        count(terms, owner, (mix(words) % U64(TERMS)).astype(np.int64))
    return out


def _damped(counts: np.ndarray) -> np.ndarray:
    """Counts as shares of the text's own total in each block, on a square-root scale."""
    out = counts.copy()
    for block in _BLOCKS:
        out[:, block] /= np.maximum(out[:, block].sum(axis=1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@lean
def _counted(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            x = features(part.column("text"))
            yield pa.record_batch({"label": part.column("label"), "x": pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())})


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def _leading(products: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading axes of a symmetric matrix by orthogonal iteration from a fixed start: a few columns beside the matrix, where a full decomposition holds several of its size."""
    q = np.random.default_rng(0).standard_normal((len(products), 2 * DIMENSIONS)).astype(np.float32)
    for _ in range(ITERATIONS):
        q, _ = np.linalg.qr(products @ q)
    values, turn = np.linalg.eigh(q.T @ (products @ q))
    return q @ turn[:, np.argsort(values)[::-1][:k]]


class _Packed:
    """Rows of counts kept compressed; a slice of them is an array."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, part: slice) -> np.ndarray:
        return np.stack([np.frombuffer(zlib.decompress(r), np.float32) for r in self.rows[part]])


class Voters:
    """Labelled latent-semantic vectors."""

    def __init__(self, counts: np.ndarray | _Packed, labels: np.ndarray):
        # In blocks throughout: what is held of the rows is their products, not themselves.
        n = len(counts)
        blocks = [slice(i, i + 2 * BLOCK) for i in range(0, n, 2 * BLOCK)]
        seen = sum((np.count_nonzero(counts[b], axis=0) for b in blocks), np.zeros(FEATURES, np.int64))
        self.rarity = np.where(seen > 0, np.log((1 + n) / (1 + seen)) + 1, 0).astype(np.float32)
        products = np.zeros((FEATURES, FEATURES), np.float32)
        for b in blocks:
            x = _unit(_damped(counts[b]) * self.rarity)
            products += x.T @ x
        self.axes = _leading(products, min(DIMENSIONS, n)).astype(np.float64)
        del products
        vectors = [_unit(_unit(_damped(counts[b]).astype(np.float64) * self.rarity) @ self.axes) for b in blocks]
        self.vectors, self.labels = np.concatenate([*vectors, np.zeros((0, self.axes.shape[1]))]), labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def similarities(self, counts: np.ndarray) -> np.ndarray:
        """Cosines of texts and voters in the latent space."""
        return _unit(_unit(_damped(counts).astype(np.float64) * self.rarity) @ self.axes) @ self.vectors.T

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours; the share among all voters for a text without features."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        voted = [self._voted(counts[i : i + BLOCK]) for i in range(0, len(counts), BLOCK)]
        return np.where(counts.sum(axis=1) > 0, np.clip(np.concatenate([*voted, np.zeros(0)]), 0, 1), self.prior)

    def _voted(self, counts: np.ndarray) -> np.ndarray:
        near = self.similarities(counts)
        k = min(NEIGHBOURS, near.shape[1])
        # Similarity and place in one number, so that of equally near voters the first ones vote, however the texts are sliced.
        steps = np.rint(near * STEPS).astype(np.int64)
        ranked = np.arange(len(self.labels)) - steps * len(self.labels)
        which = np.sort(np.argpartition(ranked, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(steps, which, 1) / STEPS, 0) ** SHARPNESS + 1e-12
        return (weight * self.labels[which]).sum(axis=1) / weight.sum(axis=1)


@lean
def _scored(batches, voters: Broadcast):
    for batch in batches:
        for part in pieces(batch, "text"):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "score": pa.array(voters.value.scores(features(part.column("text"))))})


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED) -> Voters:
    """Voters from the labelled rows of ``docs`` that are not held out.

    Of these, the ``most_labelled`` rows with the smallest hash of their doc_id: a bounded
    sample, 8 KB a row and compressed on the way, which the driver gathers.  A document with several labels votes with
    each; rows without doc_id or label don't vote.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    chosen = named.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_counted, "label int, x binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    chosen_labels = np.array([r["label"] for r in rows], np.float32)
    packed = _Packed([bytes(r["x"]) for r in rows])
    del rows
    voters = Voters(packed, chosen_labels)
    del packed
    released()
    return voters


def scored(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, mark, score) for each row of ``docs`` (doc_id, text, anything else); mark is a hash of the text.

    A null, empty or blank text has the voters' mean label; without voters every score is
    0.5.  Of voters that are equally near the first vote, in the order of their own features
    and labels, so a score depends on the text alone.  A text counts whole, however long.  Rows that repeat a doc_id are scored each by its own text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(functools.partial(_scored, voters=sent), T.StructType([rows.schema["doc_id"], rows.schema["mark"], T.StructField("score", T.DoubleType())]))


@lean
def _accepted(batches, voters: Broadcast, least: float):
    for batch in batches:
        for part in pieces(batch, "text"):
            yield part.filter(pa.array(voters.value.scores(features(part.column("text"))) >= least))


def accepted(docs: DataFrame, voters: Voters, least: float) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, in one scan."""
    return docs.mapInArrow(functools.partial(_accepted, voters=docs.sparkSession.sparkContext.broadcast(voters), least=least), docs.schema)
