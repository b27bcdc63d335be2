"""Packing of tokenised documents into training sequences, by column generation.

Of a document of L tokens, each full ``SEQUENCE`` is a sequence by itself.  Of the rest, the
largest multiple of ``UNIT`` tokens is an item and the fewer than UNIT tokens after it are a
filler that may be cut anywhere.  The histogram of item lengths (63 bars whatever the corpus)
is the demand of a cutting-stock problem: its linear program is solved over patterns, which a
knapsack dynamic program prices; patterns are rounded down, and what is left of the demand is
packed first-fit.  Items are ranked within their length, and the rank alone says which
instance of which pattern holds them.  Fillers form one stream in the order of the ranks; it
fills what patterns leave open, then sequences of its own, the last of which are powers of
two.  So no token is shuffled: a scan tokenises, and a second pass over a narrow table with a
plan of a few hundred numbers places every piece.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import pieces
from .shared import lean, written

SEQUENCE, UNIT = 4096, 64
UNITS = SEQUENCE // UNIT
#: Words whose ids a worker keeps in each of two generations.
CACHED = 200_000

# --- tokens ---------------------------------------------------------------------------------


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


class _Kept(dict):
    """Values by word, computed when first asked for.  Of two generations the older goes when the younger is full, so what is asked for often stays."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        self[word] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Token ids of texts by a tokenizers file whose words are encoded one by one.

    In texts of Latin letters, and without the file's special tokens, words are cut here by
    the file's own rule and the ids of each distinct word are kept; any other text goes
    through the library whole.  Both give the library's ids.
    """

    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        self.by_word = bool(steps) and steps[0].get("pattern", {}).get("Regex") == self.RULE and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.model, self.kept = self.whole.model, _Kept(self._word, CACHED)
        letters, digits, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+").findall
        special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self.odd = re.compile("[^\x00-ſ]" + (f"|{special}" if special else "")).search
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: 256 + i for i, b in enumerate(hidden)}

    def _word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.kept.turn()
        return b"".join(map(self.kept.__getitem__, self.cut(text.lower())))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lean
def _tokenised(batches, path: str, end_id: int):
    """One row a document: its length, checksums of its full sequences and its item, the filler's ids, and its ranks within this task."""
    task = TaskContext.get().partitionId()
    encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
    ranks, fulls, fillers = [0] * UNITS, 0, 0
    for batch in batches:
        for part in pieces(batch, "text", 4 << 20):
            rows: dict[str, list] = {k: [] for k in ("tokens", "full_crcs", "item_crc", "filler", "rank", "fulls", "fillers")}
            for text in part.column("text").to_pylist():
                ids = encode(text or "") + end
                n = len(ids) // 4
                full, items, filler = n // SEQUENCE, n % SEQUENCE // UNIT, n % UNIT
                cut = full * SEQUENCE * 4
                view = memoryview(ids)
                rows["tokens"].append(n)
                rows["full_crcs"].append([zlib.crc32(view[i : i + SEQUENCE * 4]) for i in range(0, cut, SEQUENCE * 4)])
                rows["item_crc"].append(zlib.crc32(view[cut : cut + items * UNIT * 4]))
                rows["filler"].append(ids[len(ids) - filler * 4 :] if filler else b"")
                for k, v in (("rank", ranks[items]), ("fulls", fulls), ("fillers", fillers)):
                    rows[k].append(v)
                ranks[items] += 1
                fulls += full
                fillers += filler
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "task": pa.array([task] * part.num_rows, pa.int64()),
                    "full_crcs": pa.array(rows["full_crcs"], pa.list_(pa.int64())),
                    "filler": pa.array(rows["filler"], pa.binary()),
                }
                | {k: pa.array(rows[k], pa.int64()) for k in ("tokens", "item_crc", "rank", "fulls", "fillers")}
            )


_TOKENISED = "doc_id long, task long, full_crcs array<long>, filler binary, tokens long, item_crc long, rank long, fulls long, fillers long"

# --- cutting stock --------------------------------------------------------------------------


def best_pattern(value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of lengths 1 .. len(value) in ``size`` units of the largest total value (unbounded knapsack)."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, int)
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        m = min(room, len(value))
        with_item = value[:m] + best[room - np.arange(1, m + 1)]
        i = int(np.argmax(with_item))
        if with_item[i] > best[room] + 1e-12:
            best[room], last[room] = with_item[i], i + 1
    pattern, room = np.zeros(len(value), int), size
    while room:
        pattern[last[room] - 1] += last[room] > 0
        room -= max(1, last[room])
    return float(best[size]), pattern


def column_generation(demand: np.ndarray, size: int, most_rounds: int = 5000) -> list[tuple[np.ndarray, float]]:
    """An optimal fractional solution: patterns over the lengths 1 .. len(demand) and how often each is used."""
    lengths = np.flatnonzero(demand) + 1
    if not len(lengths):
        return []
    basis = np.diag(size // lengths).astype(float)
    wanted = demand[lengths - 1].astype(float)
    for _ in range(most_rounds):
        inverted = np.linalg.inv(basis)
        use = inverted @ wanted
        price = np.zeros(len(demand))
        price[lengths - 1] = inverted.sum(axis=0)  # every pattern costs one sequence
        worth, pattern = best_pattern(price, size)
        if worth <= 1 + 1e-9:
            break
        column = pattern[lengths - 1].astype(float)
        move = inverted @ column
        limit = np.where(move > 1e-9, np.maximum(use, 0) / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(np.argmin(limit))] = column
    use = np.linalg.solve(basis, wanted)
    out = []
    for j in range(len(lengths)):
        pattern = np.zeros(len(demand), int)
        pattern[lengths - 1] = np.rint(basis[:, j]).astype(int)
        out.append((pattern, float(use[j])))
    return out


@dataclass
class Plan:
    """Where ranks go: per item length runs of ranks, and the open places that the filler stream fills."""

    #: By item length: first rank, items of this length in one instance, first sequence, offsets within the sequence.
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = field(default_factory=dict)
    #: First stream position, first sequence, first offset, tokens of one instance, instances.
    open: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def packing_plan(demand: np.ndarray, filler: int, first: int) -> Plan:
    """Plan for ``demand[i]`` items of i + 1 units and a stream of ``filler`` tokens; sequences are numbered from ``first``."""
    used: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    for pattern, times in column_generation(demand, UNITS):
        n = int(min([np.floor(times + 1e-6), *(left[i] // pattern[i] for i in np.flatnonzero(pattern))]))
        if n > 0:
            used.append((pattern, n))
            left -= pattern * n
    rest: list[Counter] = []
    room: list[int] = []
    for length in range(len(left), 0, -1):
        for _ in range(int(left[length - 1])):
            i = next((i for i, r in enumerate(room) if r >= length), None)
            if i is None:
                rest.append(Counter())
                room.append(UNITS)
                i = len(rest) - 1
            rest[i][length] += 1
            room[i] -= length
    for c in rest:
        pattern = np.zeros(len(left), int)
        for length, n in c.items():
            pattern[length - 1] = n
        used.append((pattern, 1))
    plan, ranks, at, stream = Plan(), Counter(), first, 0
    for pattern, n in used:
        offset = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            k, size = int(pattern[i]), (i + 1) * UNIT
            plan.runs.setdefault(i + 1, []).append((ranks[i + 1], k, at, [offset + j * size for j in range(k)]))
            ranks[i + 1] += k * n
            offset += k * size
        if offset < SEQUENCE:
            plan.open.append((stream, at, offset, SEQUENCE - offset, n))
            stream += (SEQUENCE - offset) * n
        at += n
    if stream < filler:
        whole, part = divmod(filler - stream, SEQUENCE)
        if whole:
            plan.open.append((stream, at, 0, SEQUENCE, whole))
        stream, at = stream + whole * SEQUENCE, at + whole
        for bit in range(SEQUENCE.bit_length() - 1, -1, -1):
            if part >> bit & 1:
                plan.open.append((stream, at, 0, 1 << bit, 1))
                stream, at = stream + (1 << bit), at + 1
    plan.sequences = at
    return plan


# --- pieces ---------------------------------------------------------------------------------


@lean
def _placed(batches, plan: Broadcast):
    """The pieces of each document of the tokenised table, whose offsets over all tasks are given."""
    import bisect

    runs, opens = plan.value.runs, plan.value.open
    firsts = {k: [r[0] for r in v] for k, v in runs.items()}
    stream = [o[0] for o in opens]
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            n, at = r["tokens"], 0
            for i, crc in enumerate(r["full_crcs"]):
                out.append((r["doc_id"], at, SEQUENCE, crc, n, r["fulls_before"] + r["fulls"] + i, 0))
                at += SEQUENCE
            items = (n - at) // UNIT
            if items:
                rank = r["rank_before"] + r["rank"]
                first, k, sequence, offsets = runs[items][bisect.bisect_right(firsts[items], rank) - 1]
                which, slot = divmod(rank - first, k)
                out.append((r["doc_id"], at, items * UNIT, r["item_crc"], n, sequence + which, offsets[slot]))
                at += items * UNIT
            ids, place = r["filler"], r["fillers_before"] + r["fillers"]
            while at < n:
                first, sequence, offset, size, _ = opens[bisect.bisect_right(stream, place) - 1]
                which, inside = divmod(place - first, size)
                take = min(n - at, size - inside)
                begin = len(ids) - (n - at) * 4
                out.append((r["doc_id"], at, take, zlib.crc32(ids[begin : begin + take * 4]), n, sequence + which, offset + inside))
                at, place = at + take, place + take
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of ``docs`` (doc_id, text, anything else).

    A document is its text's ids by the ``tokenizer`` file without special tokens, then
    ``end_id``; a null or empty text is ``end_id`` alone.  Rows that repeat a doc_id, and rows
    without one, are documents of their own.  Every id lies in one piece; a sequence has at
    most SEQUENCE ids and is filled from 0 without gaps.
    """
    tokenised = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_tokenised, path=tokenizer, end_id=end_id), _TOKENISED), "tokenised")
    items, full = F.expr(f"tokens % {SEQUENCE} div {UNIT}"), F.expr(f"tokens div {SEQUENCE}")
    sizes = written(tokenised.groupBy("task", items.alias("items")).agg(F.count("*").alias("n"), F.sum(full).alias("fulls"), F.sum(F.col("tokens") % UNIT).alias("fillers")), "sizes")
    totals = {r["items"]: r for r in sizes.groupBy("items").agg(F.sum("n").alias("n"), F.sum("fulls").alias("fulls"), F.sum("fillers").alias("fillers")).collect()}
    demand = np.array([totals[i]["n"] if i in totals else 0 for i in range(1, UNITS)], np.int64)
    plan = docs.sparkSession.sparkContext.broadcast(packing_plan(demand, sum(r["fillers"] for r in totals.values()), sum(r["fulls"] for r in totals.values())))

    def before(column: str, *by: str):
        return F.coalesce(F.sum(column).over(W.partitionBy(*by).orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(f"{column}_before")

    # Running sums over tasks, one number a task or a task and length: rows by the number of input splits, not of documents.
    ranks = sizes.select("task", "items", before("n", "items").alias("rank_before"))
    tasks = sizes.groupBy("task").agg(F.sum("fulls").alias("fulls"), F.sum("fillers").alias("fillers")).withColumn("all", F.lit(0))
    tasks = tasks.select("task", before("fulls", "all"), before("fillers", "all"))
    placed = tokenised.withColumn("items", items).join(ranks.join(tasks, "task"), ["task", "items"])
    columns = ["doc_id", "tokens", "full_crcs", "item_crc", "filler", "rank", "fulls", "fillers", "rank_before", "fulls_before", "fillers_before"]
    return placed.select(*columns).mapInArrow(functools.partial(_placed, plan=plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
