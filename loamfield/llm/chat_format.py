"""Chat records of many layouts brought to one template.

A record is JSON.  The set of its nested field paths, hashed, is its fingerprint, and the
fingerprint selects a declarative mapping to turns, at the record's top or within an object of
it.  A layout that is not listed takes the mapping that uses most of its paths; a new one is a
line in ``MAPPINGS``, not code.  A text may be a list of parts.  What can't be mapped says why.

The template marks turns with control strings.  Inside roles and texts a backslash is doubled
and ``<|`` becomes ``<\\|``, so no text can open or close a turn and every text can be read
back exactly.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """Either ``each`` names a list of turns with fields ``role`` and ``text``, or ``turns`` names the fields of each turn in order.

    ``history`` names a list of earlier (user, assistant) pairs.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    optional: tuple[str, ...] = ()
    history: str = ""

    @property
    def paths(self) -> frozenset[str]:
        if self.each:
            return frozenset(f"{self.each}[].{x}" for x in (self.role, self.text, self.order) if x)
        return frozenset(f for _, fields in self.turns for f in fields if f not in self.optional)


MAPPINGS = (
    Mapping("turn rows", each="turns", role="role", text="text", order="turn"),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("conversations", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt and completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt and response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", turns=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",), history="history"),
    Mapping("question and answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, at: str = "") -> Iterator[str]:
    """Nested paths of the leaves of a JSON value; ``[]`` stands for any element, and alone for an empty list."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        if not value:
            yield f"{at}[]"
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).hexdigest()


class Layouts:
    """The mapping of each fingerprint, as far as seen, and the object of the record that it applies to."""

    MOST = 100_000

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known: dict[str, tuple[Mapping | None, str]] = {fingerprint(m.paths): (m, "") for m in mappings}

    def of(self, record) -> tuple[str, Mapping | None, str]:
        paths = frozenset(field_paths(record))
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) > self.MOST:
                self.__init__(self.mappings)
            self.known[key] = self._chosen(paths)
        return key, *self.known[key]

    def _chosen(self, paths: frozenset[str]) -> tuple[Mapping | None, str]:
        """The mapping that uses most of the paths, a filled list before an empty one, the outermost object and the first listed among equals."""
        within = {""} | {p[: i + 1] for p in paths for i in range(len(p)) if p[i] == "." and "[" not in p[:i]}
        best = (0, 0, 0, None, "")
        for at in sorted(within, key=lambda a: (a.count("."), a)):
            here = [p[len(at) :] for p in paths if p.startswith(at)]
            # A field may hold a text, or a list of parts or an object in its place.
            there = {p[:i] for p in here for i in range(len(p) + 1) if i == len(p) or p[i] in ".["} | set(here)
            for m in self.mappings:
                full = m.paths <= there
                if full or (m.each and f"{m.each}[]" in here):
                    used = len(m.paths) + sum(f in there for f in (*m.optional, m.history) if f) if full else 0
                    if (full, used, 1) > best[:3]:
                        best = (full, used, 1, m, at)
        return best[3], best[4]


def _text(value) -> str:
    if isinstance(value, list):  # parts of a text: strings, or objects with one
        return "".join(p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) else _text(p) for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping, at: str = "") -> list[tuple[str, str]]:
    for name in filter(None, at.split(".")):
        record = record[name]
    if mapping.each:
        rows = [t for t in record.get(mapping.each) or () if isinstance(t, dict)]
        if mapping.order:
            rows.sort(key=lambda t: (t.get(mapping.order) is not None, t.get(mapping.order) or 0))
        return [(mapping.roles.get(r := _text(t.get(mapping.role)), r), _text(t.get(mapping.text))) for t in rows]
    out = []
    for pair in (record.get(mapping.history) if mapping.history else None) or ():
        out += zip(("user", "assistant"), map(_text, pair if isinstance(pair, list) else [pair]), strict=False)
    for role, fields in mapping.turns:
        parts = [_text(record.get(f)) for f in fields if f in record]
        if any(f not in mapping.optional for f in fields) or any(parts):
            out.append((role, "\n".join(p for p in parts if p)))
    return out


_BACK = re.compile(r"\\(.)")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template's text, and the code points [start, stop) of each assistant text, which the loss covers."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((unescaped(text[at + len(START) : line]), unescaped(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


_SPAN = T.StructType().add("start", "integer").add("stop", "integer")
_ADDED = T.StructType().add("fingerprint", "string").add("layout", "string").add("reason", "string").add("formatted", "string").add("loss", T.ArrayType(_SPAN))


@lean
def _formatted(batches, key: str):
    layouts = Layouts()
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("fingerprint", "layout", "reason", "formatted", "loss")}
        for raw in batch.column("record").to_pylist():
            reason = None if raw else "no record"
            try:
                record = json.loads(raw) if raw else {}
            except (ValueError, RecursionError):
                record, reason = {}, "not JSON"
            print_, mapping, at = layouts.of(record)
            if not mapping and not reason:
                reason = "no mapping for " + ", ".join(sorted(set(field_paths(record)))[:20])
            text, spans = formatted(turns_of(record, mapping, at)) if mapping else ("", [])
            for k, v in (("fingerprint", print_), ("layout", mapping and mapping.name), ("reason", reason), ("formatted", text), ("loss", [{"start": a, "stop": b} for a, b in spans])):
                rows[k].append(v)
        names = ("fingerprint", "layout", "reason", "formatted")
        yield pa.record_batch([batch.column(key), *(pa.array(rows[k], pa.string()) for k in names), pa.array(rows["loss"], span)], names=[key, *names, "loss"])


def chats(records: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint, layout, reason, formatted, loss) for each row of ``records`` (key, record, anything else).

    A record that is null, not JSON or of no known layout has a null layout, no turns and a
    reason; one whose only turns are an empty list has its layout and no turns.  Null roles and texts are empty.
    """
    rows = records.select(key, "record")
    return rows.mapInArrow(functools.partial(_formatted, key=key), T.StructType([*rows.schema.fields[:1], *_ADDED.fields]))


def from_turn_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record) with the turn rows of each key in one record.

    Turns come in order of ``turn``, nulls first, then of role and text; repeated rows stay.
    A conversation is one record, so its rows meet in one task, as the template demands.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("turns")), {"ignoreNullFields": "false"}).alias("record"))
