"""SentencePiece encoding and decoding by a Viterbi pass that words share.

The distinct marked words of a batch are sorted, which is a depth-first walk of their trie,
and the forward pass keeps its state on a stack: a word starts where it leaves the word
before.  The public model at hand is a merge model, not a unigram one, so a path's score is
whether its neighbouring pieces agree: a pair agrees when merging the two pieces' characters
alone gives just these two.  Every prefix then has one path that scores, the library's, and
the state of a prefix is that path's last piece.  (Adding up the model's piece scores
instead, as for a unigram model, would give other pieces than the library.)
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashing import pieces
from .shared import lean

MARK = "▁"
#: Words whose ids a worker keeps, before it starts anew.
CACHED = 200_000


class PieceCodec:
    """Ids of texts and texts of ids, by a SentencePiece model file with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.codes = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids) or model.normalize("A  ﬁ\n") != "▁A▁▁ﬁ\n":
            raise ValueError("words of this model can't be encoded one by one")
        self.known = 0
        surface = [b""] * n
        for p, i in self.ids.items():
            surface[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.array([len(x) for x in surface], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.kept: dict[str, bytes] = {}

    @functools.cached_property
    def tails(self) -> dict[str, dict[str, bool] | bool]:
        """What may end a piece; of a piece itself, the pieces known to agree or not with it on their right."""
        out: dict[str, dict[str, bool] | bool] = {p[i:]: False for p in self.ids for i in range(len(p) - 1)}
        return out | {p: {} for p in self.ids if len(p) > 1}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agree(self, left: str, piece: str) -> bool:
        """Whether ``piece`` may follow ``left``, or begin a word if that is empty; kept beside the piece."""
        if self.known > CACHED:
            for v in self.tails.values():
                if v:
                    v.clear()
            self.known = 0
        self.known += 1
        ok = self.tails[piece][left] = self.merged(left + piece) == ([left, piece] if left else [piece])
        return ok

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of each of the sorted distinct words, from one stack of forward states."""
        last: list[str] = [""]
        before = ""
        tail, check = self.tails.get, self._agree
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                state = word[end - 1]
                for start in range(end - 2, -1, -1):
                    known = tail(word[start:end])
                    if known is None:
                        break
                    if known is not False:
                        ok = known.get(last[start])
                        if ok is None:
                            ok = check(last[start], word[start:end])
                        if ok:
                            state = word[start:end]
                            break
                last.append(state)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            before = word
            yield word, out[::-1]

    def _packed(self, parts: list[str]) -> bytes:
        try:
            return b"".join(map(self.codes.__getitem__, parts))
        except KeyError:  # characters outside the model
            for p in parts:
                if p not in self.codes:
                    ids = [self.bytes[b] for b in p.encode()] if self.bytes else [self.unknown]
                    self.codes[p] = np.array(ids, "<u4").tobytes()
            return b"".join(map(self.codes.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for words in cut for w in words}
        if len(self.kept) > CACHED:
            self.kept.clear()
        new.difference_update(self.kept)
        for word, parts in self.walk(sorted(new)):
            self.kept[word] = self._packed(parts)
        of = self.kept.__getitem__
        return [b"".join(map(of, words)) for words in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        size = self.size[every]
        ends = np.cumsum(size)
        gather = np.repeat(self.place[every] - ends + size, size)
        gather += np.arange(len(gather))
        raw = self.surface[gather].tobytes()
        at = np.concatenate([[0], ends])[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


@lean
def _encoded(batches, path: str):
    for batch in batches:
        for part in pieces(batch, "text", 4 << 20):
            ids = codec(path).encode([t or "" for t in part.column("text").to_pylist()])
            kept = [x for x in part.schema.names if x != "text"]
            yield pa.record_batch([*(part.column(x) for x in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])


@lean
def _decoded(batches, path: str):
    for batch in batches:
        kept = [x for x in batch.schema.names if x != "ids"]
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids = part.column("ids").to_pylist()
            texts = [t if i is not None else None for i, t in zip(ids, codec(path).decode([i or b"" for i in ids]), strict=True)]
            yield pa.record_batch([*(part.column(x) for x in kept), pa.array(texts, pa.string())], names=[*kept, "text"])


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (text, anything else) with ids BINARY (little-endian unsigned 32-bit) in place of text.

    A null or empty text has no ids.  U+2581 stands for a space in the model and is read back
    as one.  Rows are taken one by one: repeated rows and ids stay.
    """
    rows = docs.drop("ids")
    kept = [c for c in rows.columns if c != "text"]
    return rows.select(*kept, "text").mapInArrow(functools.partial(_encoded, path=model), T.StructType([*(rows.schema[c] for c in kept), T.StructField("ids", T.BinaryType())]))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (ids BINARY, anything else) with text in place of ids; null ids give a null text."""
    rows = rows.drop("text")
    kept = [c for c in rows.columns if c != "ids"]
    return rows.select(*kept, "ids").mapInArrow(functools.partial(_decoded, path=model), T.StructType([*(rows.schema[c] for c in kept), T.StructField("text", T.StringType())]))
