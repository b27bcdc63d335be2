"""ISO base media files: an index of their samples, without decoding payloads.

The reader walks nested boxes and decodes the sample tables (time to sample, sample to chunk,
sizes, chunk offsets, sync samples) and the runs of movie fragments, of every track, into
codec, duration and the byte range of every keyframe.  The writer stores bytes losslessly as 8-bit samples, 64 to an access unit.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean

UNIT, RATE, UNITS_A_CHUNK = 64, 8000, 16
#: Boxes that hold boxes only.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"])


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write(payload: bytes) -> bytes:
    """A media file with one track of unsigned 8-bit samples; ``payload`` is a multiple of UNIT bytes."""
    units, ragged = divmod(len(payload), UNIT)
    if ragged:
        raise ValueError(f"a payload is a multiple of {UNIT} bytes")
    chunks = -(-units // UNITS_A_CHUNK)
    last = units - (chunks - 1) * UNITS_A_CHUNK
    runs = ([(1, UNITS_A_CHUNK, 1)] if chunks > 1 or last == UNITS_A_CHUNK else []) + ([(chunks, last, 1)] if chunks and last != UNITS_A_CHUNK else [])
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = units * UNIT
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    wide = len(payload) >= 1 << 31

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_A_CHUNK)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * UNITS_A_CHUNK + 1).astype(">u4").tobytes()),
        )
        track = _box(
            b"trak",
            _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, struct.pack(">II", 0, 0), flags=3),
            _box(
                b"mdia",
                _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)),
                _full(b"hdlr", struct.pack(">I4s", 0, b"soun"), bytes(12), b"samples\0"),
                _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
            ),
        )
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")
    body = _box(b"mdat", payload)
    first = len(head) + len(moov(0)) + len(body) - len(payload)
    return head + moov(first) + body


def boxes(data: memoryview, at: int = 0, end: int | None = None):
    """(kind, first byte, first byte of the contents, end) of each box in order; a box beyond its parent is an error."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield kind, at, at + head, at + size
        at += size


def tree(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, first byte, first byte of the contents, end) of every box, parents before children."""
    for kind, start, a, b in boxes(data, at, end):
        yield (*path, kind), start, a, b
        if kind in CONTAINERS:
            yield from tree(data, a, b, (*path, kind))


def _table(data: memoryview, a: int, b: int, columns: int, wide: bool = False) -> np.ndarray:
    n = struct.unpack_from(">I", data, a + 4)[0]
    size = 8 if wide else 4
    if a + 8 + n * columns * size > b:
        raise ValueError("a table is cut short")
    return np.frombuffer(data, ">u8" if wide else ">u4", n * columns, a + 8).reshape(n, columns).astype(np.int64)


class _Track:
    """What is known of a track: its tables, and the samples found so far."""

    def __init__(self) -> None:
        self.id, self.tables = 0, {}
        self.offsets, self.sizes, self.sync, self.played = [], [], [], 0


def _sizes(data: memoryview, track: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stz2" in track:
        a, b = track[b"stz2"]
        bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or a + 12 + -(-count * bits // 8) > b:
            raise ValueError("a table is cut short")
        if bits == 4:
            halves = np.frombuffer(data, np.uint8, -(-count // 2), a + 12)
            return np.column_stack([halves >> 4, halves & 15]).ravel()[:count].astype(np.int64)
        return np.frombuffer(data, ">u2" if bits == 16 else np.uint8, count, a + 12).astype(np.int64)
    a, b = track[b"stsz"]
    fixed, count = struct.unpack_from(">II", data, a + 4)
    if count * max(fixed, 4 * (not fixed)) > len(data):
        raise ValueError("there are more samples than bytes")
    return np.full(count, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", count, a + 12).astype(np.int64)


def _tabled(data: memoryview, track: _Track) -> None:
    """Adds the samples of a track's tables."""
    boxes_ = track.tables
    if not {b"stsd", b"stts", b"stsc", b"mdhd"} <= boxes_.keys() or not {b"stco", b"co64"} & boxes_.keys() or not {b"stsz", b"stz2"} & boxes_.keys():
        raise ValueError("a track without sample tables")
    sizes = _sizes(data, boxes_)
    count = len(sizes)
    places = _table(data, *boxes_[b"co64"], 1, True)[:, 0] if b"co64" in boxes_ else _table(data, *boxes_[b"stco"], 1)[:, 0]
    runs = _table(data, *boxes_[b"stsc"], 3)
    chunks = np.diff(np.append(runs[:, 0], len(places) + 1))
    a_chunk = np.repeat(runs[:, 1], chunks)
    if int(a_chunk.sum()) != count:
        raise ValueError("the chunks hold another number of samples")
    times = _table(data, *boxes_[b"stts"], 2)
    if int(times[:, 0].sum()) != count:
        raise ValueError("the times count another number of samples")
    chunk = np.repeat(np.arange(len(places)), a_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(a_chunk) - a_chunk
    sync = np.zeros(count, bool)
    sync[_table(data, *boxes_[b"stss"], 1)[:, 0] - 1 if b"stss" in boxes_ else slice(None)] = True
    track.offsets.append(places[chunk] + before - before[first][chunk] if count else np.zeros(0, np.int64))
    track.sizes.append(sizes)
    track.sync.append(sync)
    track.played += int((times[:, 0] * times[:, 1]).sum())


def _run(data: memoryview, a: int, b: int, track: _Track, base: int, after: int, usual: dict[str, int]) -> int:
    """Adds the samples of one run of a fragment and returns the byte after them."""
    flags, count = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at, lead = a + 8, None
    if flags & 1:
        after, at = base + struct.unpack_from(">i", data, at)[0], at + 4
    if flags & 4:
        lead, at = struct.unpack_from(">I", data, at)[0], at + 4
    fields = [name for bit, name in ((0x100, "time"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if at + 4 * len(fields) * count > b or count > len(data):
        raise ValueError("a run is cut short")
    table = np.frombuffer(data, ">u4", count * len(fields), at).reshape(count, len(fields)).astype(np.int64)
    column = lambda name: table[:, fields.index(name)] if name in fields else np.full(count, usual[name], np.int64)
    sizes, marks = column("size"), column("flags").copy()
    if lead is not None and count:
        marks[0] = lead
    track.offsets.append(after + np.cumsum(sizes) - sizes)
    track.sizes.append(sizes)
    track.sync.append(marks & 0x10000 == 0)
    track.played += int(column("time").sum())
    return after + int(sizes.sum())


def _usual(data: memoryview, a: int, known: dict[str, int]) -> tuple[int, int | None, bool, dict[str, int]]:
    """Track, first byte, whether bytes count from the fragment, and defaults of a fragment's header."""
    flags, track = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at, base, usual = a + 8, None, dict(known)
    if flags & 1:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    at += 4 * bool(flags & 2)
    for bit, name in ((8, "time"), (0x10, "size"), (0x20, "flags")):
        if flags & bit:
            usual[name], at = struct.unpack_from(">I", data, at)[0], at + 4
    return track, base, bool(flags & 0x20000), usual


def tracks(media: bytes) -> list[dict]:
    """Of each track its id, kind, codec, timescale, duration, and offset, size and sync flag of each sample, those of fragments included.

    The duration is what the header says, or the samples' own where that is more, as in files
    of fragments.  Anything cut short, or beyond the file, is an error.
    """
    data = memoryview(media)
    found: list[_Track] = []
    usual: dict[int, dict[str, int]] = {}
    moof = base = after = 0
    track, values = None, {}
    for path, start, a, b in tree(data):
        kind = path[-1]
        if kind == b"trak":
            found.append(_Track())
        elif b"trak" in path:
            found[-1].tables[kind] = (a, b)
            if kind == b"tkhd":
                found[-1].id = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        elif kind == b"trex":
            number, _, time, size, flags = struct.unpack_from(">5I", data, a + 4)
            usual[number] = {"time": time, "size": size, "flags": flags}
        elif kind == b"moof":
            moof = after = start
            for t in found:
                if not t.offsets:
                    _tabled(data, t)
        elif kind == b"tfhd":
            number, first, own, values = _usual(data, a, usual.get(struct.unpack_from(">I", data, a + 4)[0], {"time": 0, "size": 0, "flags": 0}))
            track = next((t for t in found if t.id == number), None)
            if track is None:
                raise ValueError("a fragment of no track")
            base = after = first if first is not None else moof if own else after
        elif kind == b"trun":
            if track is None:
                raise ValueError("a run without a fragment's header")
            after = _run(data, a, b, track, base, after, values)
    if not found:
        raise ValueError("no track with sample tables")
    out = []
    for t in found:
        if not t.offsets:
            _tabled(data, t)
        a, _ = t.tables[b"mdhd"]
        scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        offsets, sizes, sync = np.concatenate(t.offsets), np.concatenate(t.sizes), np.concatenate(t.sync)
        if len(offsets) and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
            raise ValueError("a sample lies beyond the file")
        entry = t.tables[b"stsd"][0] + 12
        kind = bytes(data[t.tables[b"hdlr"][0] + 8 : t.tables[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in t.tables else ""
        out.append({"id": t.id, "kind": kind, "codec": bytes(data[entry : entry + 4]).decode("latin-1"), "timescale": int(scale), "duration": max(int(duration), t.played), "offsets": offsets, "sizes": sizes, "sync": sync})
    return out


def index(media: bytes) -> dict:
    """The first track with samples, or the first of all; see :func:`tracks`."""
    every = tracks(media)
    return next((t for t in every if len(t["sizes"])), every[0])


def samples(media: bytes, found: dict) -> bytes:
    """The stored bytes of all samples in order, by the index."""
    at, size = found["offsets"], found["sizes"]
    if not len(at):
        return b""
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + size[:-1]]))
    ends = np.append(head[1:], len(at)) - 1
    data = memoryview(media)
    return b"".join(data[a:b] for a, b in zip(at[head].tolist(), (at[ends] + size[ends]).tolist(), strict=True))


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and it with zeros up to a positive multiple of UNIT bytes."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


@lean
def _encoded(batches):
    from .hashing import pieces

    for batch in batches:
        for part in pieces(batch, "text", 4 << 20):
            both = [padded(t) for t in part.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array([n for n, _ in both], pa.int64()), "media": pa.array([write(p) for _, p in both], pa.binary())})


def from_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of ``docs`` (doc_id, text, anything else); a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


_SPANS = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
_TRACK = T.StructType().add("id", "long").add("kind", "string").add("codec", "string").add("seconds", "double").add("n_samples", "long").add("keyframes", _SPANS)
_ADDED = T.StructType().add("codec", "string").add("seconds", "double").add("n_samples", "long").add("keyframes", _SPANS).add("tracks", T.ArrayType(_TRACK)).add("error", "string")


def _described(x: dict) -> dict:
    at, size = x["offsets"][x["sync"]], x["sizes"][x["sync"]]
    spans = [{"start": a, "stop": b} for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
    return {"id": x["id"], "kind": x["kind"], "codec": x["codec"], "seconds": x["duration"] / x["timescale"] if x["timescale"] else None, "n_samples": len(x["sizes"]), "keyframes": spans}


@lean
def _indexed(batches):
    track = pa.struct([("id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)])
    kinds = {"codec": pa.string(), "seconds": pa.float64(), "n_samples": pa.int64(), "keyframes": _RANGES, "tracks": pa.list_(track), "error": pa.string()}
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in kinds}
        for media in batch.column("media"):
            try:
                every, error = [_described(t) for t in tracks(media.as_buffer())] if media.is_valid else None, None if media.is_valid else "no media"
            except (ValueError, struct.error, IndexError, OverflowError) as e:
                every, error = None, str(e)[:200] or type(e).__name__
            first = next((t for t in every if t["n_samples"]), every[0]) if every else {}
            for k in rows:
                rows[k].append({"tracks": every, "error": error}.get(k, first.get(k)))
        yield pa.record_batch([*batch.columns, *(pa.array(rows[k], t) for k, t in kinds.items())], names=[*batch.schema.names, *kinds])


def with_index(rows: DataFrame) -> DataFrame:
    """``rows`` (media BINARY, anything else) with codec, seconds, n_samples, keyframes (byte ranges), tracks and error.

    tracks has a struct of (id, kind, codec, seconds, n_samples, keyframes) for every track;
    the columns before it are those of the first with samples.  Samples of fragments count.
    Null media, and bytes that are no ISO media file or a damaged one, have nulls and an
    error; columns of ``rows`` with those names are replaced.
    """
    rows = rows.drop(*_ADDED.names)
    return rows.mapInArrow(_indexed, T.StructType([*rows.schema.fields, *_ADDED.fields]))
