from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamfield.llm import chat_format, license_scan, media, packing, piece_codec, quality, url_filter
from loamfield.llm.queries import tokenizer_file


# --- chats


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(), st.text(alphabet=st.sampled_from("<|im_endstar>\\ \n漢aé"), max_size=60)), max_size=6))
def test_chats_are_read_back(turns):
    text, spans = chat_format.formatted(turns)
    assert chat_format.read_back(text) == turns
    assert [chat_format.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\nit"), ("assistant", "done")]),
        ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c", "system": "s", "extra": {"n": [1, 2]}}, "prompt and completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"turns": [{"turn": 2, "role": "assistant", "text": "b"}, {"turn": 1, "role": "user", "text": "a"}]}, "turn rows", [("user", "a"), ("assistant", "b")]),
        ({"messages": []}, "messages", []),
        ({"something": "else"}, None, []),
        ({"data": {"prompt": "p", "completion": "c"}, "id": 7}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
        ({"a": {"b": {"messages": [{"role": "user", "content": "q"}]}}}, "messages", [("user", "q")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a "}, "b", {"type": "image", "url": "x"}]}]}, "messages", [("user", 'a b{"type": "image", "url": "x"}')]),
        ({"prompt": "p", "response": "r", "messages": []}, "prompt and response", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "do", "output": "done", "history": [["q1", "a1"], ["q2", None]]}, "instruction", [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", ""), ("user", "do"), ("assistant", "done")]),
        ({"messages": [{"role": "user", "content": "a" * 300_000}, {"role": "assistant", "content": "<|im_end|>" * 30_000}]}, "messages", [("user", "a" * 300_000), ("assistant", "<|im_end|>" * 30_000)]),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, None), (91, "no json"), (None, "[1]")]
    got = {r.id: r for r in chat_format.chats(spark.createDataFrame(rows, "id long, record string").withColumn("layout", F.lit("clash")), "id").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert (got[i].layout, chat_format.read_back(got[i].formatted)) == (layout, turns)
    assert all(got[i].layout is None and got[i].formatted == "" for i in (90, 91, None))
    assert got[2].fingerprint != got[3].fingerprint
    assert got[7].reason == "no mapping for something" and got[90].reason == "no record" and got[91].reason == "not JSON" and got[0].reason is None


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"), (2, 0, "user", "<|im_end|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = {r.conv_id: chat_format.read_back(r.formatted) for r in chat_format.chats(chat_format.from_turn_rows(table), "conv_id").collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "x")], 2: [("user", "<|im_end|>")]}
    assert chat_format.chats(chat_format.from_turn_rows(table.limit(0)), "conv_id").count() == 0


def test_query_of_awkward_conversations(spark, tmp_path):
    """The query's columns on repeated, null, clashing and empty rows, by hand; and on an empty table, where only conversation -1 is left."""
    from loamfield.llm.queries import op1_chat_format

    kinds = "conv_id long, turn long, role string, text string, record string, formatted string"
    rows = [(1, 0, "user", None, "x", "y"), (1, 0, "user", None, "x", "y"), (1, 2, "assistant", "<|im_end|>\n", None, None), (1, None, None, "first", None, None), (2, 0, "assistant", "", None, None), (3, 1, "assistant", "z" * 50_000, None, None)]
    for k, table in enumerate((rows, [])):
        spark.createDataFrame(table, kinds).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        got = {r.conv_id: r for r in op1_chat_format(spark, f"{tmp_path}/{k}").collect()}
        turns = {1: [("", "first"), ("user", ""), ("user", ""), ("assistant", "<|im_end|>\n")], 2: [("assistant", "")], 3: [("assistant", "z" * 50_000)]} if table else {}
        turns[-1] = [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
        assert got.keys() == turns.keys()
        for c, t in turns.items():
            learnt = "".join(x for r, x in t if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest())
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


# --- urls


def test_urls(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "/es/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "https://b.com/en/1", "x://com/en/", "http://xcom/en/1", "ftp://q.org/es/a#b", "a://b://c/d", "http://www.cheap-pills.example.net/en/1", "http://garden.example.net/1\n2"]
    table = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(table, rules).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[5] == ("b.com", "/en/1", "com/en/", "block") and got[6][3] == "block" and got[7][2] is None
    assert got[8] == ("q.org", "/es/a", "org/es/", "block") and got[9][:2] == ("b:", "//c/d")
    assert got[10][3] == "block" and got[11] == ("garden.example.net", "/1\n2", None, "allow")
    assert url_filter.judged(table.limit(0), rules).count() == 0 and url_filter.judged(table, []).where("rule IS NULL").count() == len(urls) + 1


def test_model_scores_as_trained(spark):
    bias, weights = url_filter.trained()
    rows = url_filter.labelled_urls()
    assert len({(h, p) for h, p, _ in rows}) == len(rows) < 1000
    table = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.logit for r in url_filter.judged(table, []).collect()}
    for i, (h, p, label) in enumerate(rows):
        assert got[i] == bias + sum(weights[b] for b in url_filter._bins(h, p)) and (got[i] > 0) == (label == 1)


def test_long_urls(spark):
    """A URL of half a million characters costs in proportion to its length, and its logit is that of plain arithmetic."""
    path = "".join(f"/{i % 9973}é" for i in range(90_000))
    table = spark.createDataFrame([(1, f"http://example.org{path}"), (2, "http://éx😀.org/a😀b")], "page_id long, url string")
    bias, weights = url_filter.trained()
    got = {r.page_id: r for r in url_filter.judged(table, []).collect()}
    assert got[1].logit == bias + sum(weights[b] for b in url_filter._bins("example.org", path))
    assert got[2].logit == bias + sum(weights[b] for b in url_filter._bins("éx😀.org", "/a😀b"))


# --- licenses


def test_licenses_in_a_long_text(spark):
    """A text of some two megabytes, with the same phrase thousands of times."""
    words = ["cc", "by"] + ["filler"] * 98
    docs = spark.createDataFrame([(1, " ".join(words * 4000)), (2, " ".join(["all rights"] * 100_000) + " Reserved")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (400_000, 4000, 0, 399_900, "cc-by")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels) == (200_001, 1, 199_998, "reserved")



def test_license_spans(spark, odd, odd_rows, none):
    got = {(r.doc_id, r.n_words): r for r in license_scan.scanned(odd).collect()}
    assert license_scan.scanned(odd).count() == len(odd_rows)
    ids = [r[0] for r in odd_rows if "Licensed under" in (r[1] or "")]
    x = next(v for (d, _), v in got.items() if d == ids[0])
    assert (x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == (2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc,reserved", 1.0)
    y = next(v for (d, _), v in got.items() if d == ids[0] + 1)
    assert (y.n_base, y.first_word, y.last_word, y.base_labels) == (3, 0, 6, "cc-by,gpl")
    assert (got[(1, 0)].n_base, got[(1, 0)].first_word, got[(1, 0)].labels, got[(1, 0)].score) == (0, None, "", 0.0)
    assert license_scan.scanned(none).count() == 0
    close = "Permission is hereby granted, free of charge, to every person obtaining one copy of this software and associated documentation files"
    near = spark.createDataFrame([(1, close), (2, "KELVIN cc by"), (3, "ＣＣ by Cc-bY")], "doc_id long, text string")
    labels = {r.doc_id: (r.labels, r.n_base) for r in license_scan.scanned(near).collect()}
    assert labels == {1: ("mit", 0) if labels[1][0] else ("", 0), 2: ("cc-by", 1), 3: ("cc-by", 1)}


# --- quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    voters = quality.fitted(docs, labels)
    rows = quality.scored(docs, voters).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    assert len(rows) > 50
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.97


def test_quality_by_vocabulary(spark):
    """Texts of one shape, told apart by their words alone."""
    rng = np.random.default_rng(3)
    good, bad = ([f"{''.join(chr(97 + c) for c in rng.integers(0, 26, 5))}" for _ in range(60)] for _ in range(2))
    text = lambda words: " ".join(words[i] for i in rng.permutation(60)[:40])
    docs = spark.createDataFrame([(i, text(good if i % 2 else bad), i % 2) for i in range(400)], "doc_id long, text string, quality int")
    voters = quality.fitted(docs, docs)
    rows = quality.scored(docs, voters).join(docs, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    assert len(rows) > 40 and all((r.score >= 0.5) == (r.quality == 1) for r in rows)


def test_every_score_is_the_plain_vote(spark, sf_dir, odd, monkeypatch):
    """Each text against each voter one by one, ties by place; on documents, on awkward rows, and with a block of one text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    voters = quality.fitted(docs, labels)
    for table in (docs, odd):
        rows = table.select("doc_id", "text", F.xxhash64("text").alias("mark")).collect()
        want = {}
        for r in rows:
            counts = quality.features(pa.array([r.text], pa.string()))[0].astype(float)
            if not counts.any():
                want[r.doc_id, r.mark] = voters.prior
                continue
            x = np.concatenate([np.sqrt(counts[b] / max(1, counts[b].sum())) for b in quality._BLOCKS]) * voters.rarity
            x = (x / np.linalg.norm(x)) @ voters.axes
            near = [round(float(np.dot(x / np.linalg.norm(x), v)) * quality.STEPS) / quality.STEPS for v in voters.vectors]
            best = sorted(range(len(near)), key=lambda i: (-near[i], i))[: quality.NEIGHBOURS]
            weights = [max(near[i], 0) ** quality.SHARPNESS + 1e-12 for i in best]
            want[r.doc_id, r.mark] = sum(w * voters.labels[i] for w, i in zip(weights, best, strict=True)) / sum(weights)
        got = {(r.doc_id, r.mark): r.score for r in quality.scored(table, voters).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-4 for k, v in want.items())
    texts = pa.array([r.text for r in docs.limit(50).collect()], pa.string())
    whole = voters.scores(quality.features(texts))
    monkeypatch.setattr(quality, "BLOCK", 1)
    assert np.allclose(whole, voters.scores(quality.features(texts)), atol=1e-7)


def test_equally_near_voters_vote_in_their_order():
    """Forty equal texts with labels in turn: the first ones vote, whatever else is scored with them."""
    counts = np.repeat(quality.features(pa.array(["one two three four"])), 40, axis=0)
    voters = quality.Voters(counts, np.array([1.0] * 10 + [0.0] * 30))
    assert np.allclose(voters.scores(counts[:1]), 10 / quality.NEIGHBOURS) and np.allclose(voters.scores(counts), 10 / quality.NEIGHBOURS)


def test_quality_of_awkward_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(8, 1), (9, 1), (30, 0), (None, 1), (3, None), (8, 0)], "doc_id long, quality int")
    voters = quality.fitted(odd, labels)
    got = quality.scored(odd, voters).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(none, voters).count() == 0
    nobody = quality.fitted(none, labels)
    assert {r.score for r in quality.scored(odd, nobody).collect()} == {0.5}
    kept = quality.accepted(odd, voters, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_features_don_t_depend_on_the_batch():
    texts = ["a b", "", "ÀÉ!! 12", None, "x " * 50]
    whole = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.array_equal(whole[i], quality.features(pa.array([t], pa.string()))[0])


# --- media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_media_round_trip(raw):
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    stored = media.write(payload)
    found = media.index(stored)
    assert media.samples(stored, found) == payload and found["codec"] == "raw " and found["duration"] == len(payload)
    keys = found["offsets"][found["sync"]]
    assert len(keys) == -(-len(payload) // 1024) and bytes(stored[keys[0] : keys[0] + 64]) == payload[:64]


def test_damaged_media(spark):
    good = media.write(b"\1" * 640)
    wide = good.replace(b"stco", b"skip")
    rows = [(1, good), (2, good[:-100]), (3, b""), (4, None), (5, b"garbage that is no box"), (6, wide), (7, struct.pack(">I4s", 4, b"moov"))]
    table = spark.createDataFrame(rows, "id long, media binary").withColumn("codec", F.lit("clash"))
    got = {r.id: (r.codec, r.n_samples, r.error is None) for r in media.with_index(table).collect()}
    assert got.pop(1) == ("raw ", 10, True)
    assert all(v == (None, None, False) for v in got.values())


def _fragmented() -> tuple[bytes, list[bytes]]:
    """Two tracks without tabled samples, and two fragments: defaults from the movie, the fragment and the run; places from the fragment and from the run before."""
    box, full = media._box, media._full

    def trak(number: int, kind: bytes, codec: bytes, scale: int) -> bytes:
        none = struct.pack(">I", 0)
        table = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", none), full(b"stsc", none), full(b"stsz", none, none), full(b"stco", none))
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, 0, 0x55C4, 0))
        return box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60), flags=3), box(b"mdia", mdhd, full(b"hdlr", struct.pack(">I4s", 0, kind), bytes(13)), box(b"minf", table)))

    trex = lambda n, time, size, flags: full(b"trex", struct.pack(">5I", n, 1, time, size, flags))
    head = box(b"ftyp", b"iso5", bytes(4)) + box(b"moov", full(b"mvhd", bytes(96)), trak(1, b"vide", b"avc1", 1000), trak(2, b"soun", b"mp4a", 8000), box(b"mvex", trex(1, 40, 0, 0x10000), trex(2, 1024, 5, 0)))
    video, audio = [b"K" * 9, b"p" * 4, b"q" * 3, b"L" * 7], [b"a" * 5, b"b" * 5, b"c" * 5]

    def moof(first: int) -> bytes:
        one = box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), full(b"trun", struct.pack(">IiI", 2, first, 0), struct.pack(">II", 9, 4), flags=0x205), full(b"trun", struct.pack(">I", 1), struct.pack(">I", 3), flags=0x200))
        two = box(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), full(b"trun", struct.pack(">Ii", 2, first + 16), flags=1))
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), one, two)

    head += moof(len(moof(0)) + 8) + box(b"mdat", *video[:3], *audio[:2])
    late = lambda first: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IQI", 1, first, 100), flags=0x9), full(b"trun", struct.pack(">III", 1, 0, 7), flags=0x204)), box(b"traf", full(b"tfhd", struct.pack(">I", 2)), full(b"trun", struct.pack(">I", 1))))
    first = len(head) + len(late(0)) + 8
    return head + late(first) + box(b"mdat", video[3], audio[2]), [b"".join(video), b"".join(audio)]


def test_fragments_and_every_track(spark):
    data, stored = _fragmented()
    found = media.tracks(data)
    assert [media.samples(data, t) for t in found] == stored
    assert [(t["id"], t["kind"], t["codec"], t["duration"], len(t["sizes"])) for t in found] == [(1, "vide", "avc1", 220, 4), (2, "soun", "mp4a", 3072, 3)]
    assert found[0]["sync"].tolist() == [True, False, False, True] and found[1]["sync"].all()
    rows = [(1, data), (2, data[:-3]), (3, data.replace(b"tfhd", b"skip"))]
    got = {r.id: r for r in media.with_index(spark.createDataFrame(rows, "id long, media binary").withColumn("tracks", F.lit(1))).collect()}
    assert [(t.kind, t.seconds, t.n_samples, len(t.keyframes)) for t in got[1].tracks] == [("vide", 0.22, 4, 2), ("soun", 0.384, 3, 3)]
    assert (got[1].codec, got[1].n_samples) == ("avc1", 4) and data[slice(*got[1].keyframes[1])] == b"L" * 7
    assert all(got[i].tracks is None and got[i].error for i in (2, 3))


def test_media_columns_by_plain_arithmetic(spark, sf_dir):
    """Every column of the query from the text alone: the payload by hand, the file by its parts, places by counting."""
    from loamfield.llm.queries import op7_media

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_media(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        stored = media.write(payload)
        assert stored.endswith(struct.pack(">I4s", len(payload) + 8, b"mdat") + payload)
        first = len(stored) - len(payload)
        feature = f"codec=raw;seconds={len(payload) / 8000:.3f};samples={len(payload) // 64};keyframes={-(-len(payload) // 1024)};first={first}-{first + 64}"
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want


def test_media_of_awkward_rows(odd, odd_rows, none):
    got = media.with_index(media.from_texts(odd)).collect()
    assert len(got) == len(odd_rows) and all(r.error is None and r.n_samples >= 1 for r in got)
    assert media.with_index(media.from_texts(none)).count() == 0


# --- packing


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(tokenizer_file("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from("'stdvlm <|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_word_encoder(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def _check_packing(docs, encoder) -> float:
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(encoder.encode(r.text or "") + b"\2\0\0\0")
    pieces, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, tokenizer_file("word_bpe_49k.json")).collect():
        pieces[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for d, of in ids.items():
        want = sorted((i, zlib.crc32(x[i * 4 : i * 4 + 4])) for x in of for i in range(len(x) // 4)) if len(of) > 1 else None
        if want is None:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.ids_crc32 == zlib.crc32(of[0][at * 4 : (at + r.length) * 4])
                at += r.length
            assert at == len(of[0]) // 4 == pieces[d][0].doc_tokens
        else:
            assert sum(r.length for r in pieces[d]) == sum(len(x) // 4 for x in of)
    padding = total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 4096 - at if at & (at - 1) else 0
    return padding / max(1, total)


def test_packing(spark, sf_dir, odd, none, encoder):
    assert _check_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), encoder) < 0.02
    _check_packing(odd, encoder)
    assert packing.packed(none, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_column_generation_is_optimal():
    # Four of 48, 8 of 16 units: a 48 and a 16 make a sequence, four 16 another.
    demand = np.zeros(63, int)
    demand[47], demand[15] = 4, 8
    assert abs(sum(x for _, x in packing.column_generation(demand, 64)) - 5) < 1e-9
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 500, 63)
    solution = packing.column_generation(demand, 64)
    assert np.allclose(sum(p * x for p, x in solution), demand) and all(x > -1e-9 and p @ np.arange(1, 64) <= 64 for p, x in solution)
    # Prices of the lengths under which no pattern is worth more than one, and all demand costs as much, prove it.
    prices = np.linalg.solve(np.array([p for p, _ in solution], float), np.ones(63))
    assert packing.best_pattern(prices, 64)[0] < 1 + 1e-6
    assert abs(prices @ demand - sum(x for _, x in solution)) < 1e-6


# --- pieces


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("etaoin shr ▁\n"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_pieces_are_the_library_s(codec, library, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == library.encode(texts)
    assert codec.decode(ids) == [library.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]


def test_piece_tables(odd, odd_rows, none):
    model = tokenizer_file("piece_bpe_32k.model")
    back = piece_codec.decoded(piece_codec.encoded(odd, model), model)
    assert set(back.columns) == set(odd.columns)
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in odd_rows)
    assert piece_codec.encoded(none, model).count() == 0


def test_digests_of_odd_rows(odd, odd_rows):
    stored = {hashlib.sha256(r.media).hexdigest() for r in media.from_texts(odd).collect()}
    assert len(stored) == len({(r[1] or "").rstrip("\0") for r in odd_rows})
