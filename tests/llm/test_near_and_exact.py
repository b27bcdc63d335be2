from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loamfield.llm import exact_dedup, fm_index, ngram_jaccard, substring_dedup
from loamfield.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0d]+")


def _shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows: list[tuple], percent: int = 80) -> dict:
    sets = [(d, _shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in parent}


def test_components_of_awkward_rows(odd, odd_rows):
    got = ngram_jaccard.similarity_components(odd).collect()
    want = brute_components([(r[0], r[1]) for r in odd_rows])
    assert sorted((str(r[0]), len(_shingles(r[1])), str(want.get(r[0]))) for r in odd_rows) == sorted((str(g.doc_id), g.n_shingles, str(g.component_id)) for g in got)


def test_components_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in ngram_jaccard.similarity_components(docs).collect()} == want


def test_frequent_tokens(spark, monkeypatch):
    """With every token frequent, or every other one, sets go by combinations; sizes from 1 to some hundred, several similarities."""
    import random

    rng = random.Random(3)
    rows = []
    for g in range(14):
        base = [f"g{g}w{i}" for i in range(rng.randint(5, 70) if g < 12 else 160)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
            rows.append((len(rows), " ".join(w[: rng.randint(len(w) - 3, len(w))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent, percents in ((1, (80, 90, 62, 45)), (8, (80, 55))):
        monkeypatch.setattr(ngram_jaccard, "FREQUENT", frequent)
        for percent in percents:
            got = ngram_jaccard.similarity_components(docs, percent=percent).collect()
            assert {r.doc_id: r.component_id for r in got} == brute_components(rows, percent)


def test_entries_of_similar_sets_meet():
    """Of random similar sets over a small alphabet with any tokens frequent, some key is in both, and its bound allows the overlap."""
    import numpy as np

    rng = np.random.default_rng(2)
    for trial in range(3000):
        classes = rng.choice(np.array([0, 4, 16, 20], np.uint8), 1 << ngram_jaccard.SKETCH_BITS, p=[0.02, 0.03, 0.45, 0.5] if trial % 2 else [0.3, 0.2, 0.3, 0.2]) if trial % 100 < 2 else classes
        n, percent = int(rng.integers(1, 60)), int(rng.choice([40, 51, 60, 80, 95]))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        t = np.unique(np.concatenate([s[rng.random(len(s)) > rng.choice([0, 0.1, 0.2])], rng.integers(0, 2**63, rng.integers(0, max(1, n // 4) + 1)).astype(np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(s, t))
        if len(t) and 100 * both >= percent * (len(s) + len(t) - both):
            (k1, a1), (k2, a2) = (ngram_jaccard._entries(x, classes, percent) for x in (s, t))
            first, second = dict(zip(k1.tolist(), a1.tolist(), strict=True)), dict(zip(k2.tolist(), a2.tolist(), strict=True))
            assert any(min(len(s) - first[k], len(t) - second[k]) >= ngram_jaccard.least_overlap(len(s) + len(t), percent) for k in first.keys() & second.keys())


def test_one_of_each_keeps_columns(odd, none):
    kept = ngram_jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 8 in ids and 9 not in ids and 12 not in ids and ids.count(None) == 2
    assert ngram_jaccard.one_of_each(none).count() == 0


def test_component_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (7, 7), (200, 200), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 98: 98, 99: 98, 100: 98, 200: 200}


def _groups(rows: list[tuple], last: bool) -> list[tuple]:
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    out = []
    for d, t in rows:
        named = [x for x in by[t or ""] if x is not None]
        keep = (max if last else min)(named, default=None)
        out.append((d, keep, len(by[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_exact_copies(odd, odd_rows, none):
    rows = [(r[0], r[1]) for r in odd_rows]
    for keep in ("min", "max"):
        for buckets in (None, 1, 9):
            got = [tuple(r) for r in exact_dedup.duplicates(odd, keep=keep, buckets=buckets).collect()]
            assert sorted(map(str, got)) == sorted(map(str, _groups(rows, keep == "max")))
    assert exact_dedup.duplicates(none).count() == 0


def test_hot_copies_lie_in_many_buckets(spark, monkeypatch):
    """A text that half of the rows have, cut over buckets, and texts of one start; also where the digest tells nothing apart."""
    start = "a long common start of many texts "
    rows = [(i, "hot " * 30 if i % 2 else f"{start}{i % 7}" if i % 3 else f"own {i}") for i in range(600)] + [(None, "hot " * 30), (-(2**63), "own 6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for digest in (exact_dedup._digest, lambda text: F.lit(1).cast("long")):
        monkeypatch.setattr(exact_dedup, "_digest", digest)
        for keep in ("min", "max"):
            got = [tuple(r) for r in exact_dedup.duplicates(docs, keep=keep, buckets=40).collect()]
            assert sorted(map(str, got)) == sorted(map(str, _groups(rows, keep == "max")))


def test_neighbours_decide(odd, monkeypatch):
    """Without the comparison of neighbours no copy is found: nothing else looks for them."""
    monkeypatch.setattr(exact_dedup, "_leads", lambda text, order: F.lag(F.lit(1)).over(order).isNull() | F.lit(True))
    assert {r.group_size for r in exact_dedup.duplicates(odd).collect()} == {1}


def test_without_duplicates(odd, odd_rows, none):
    kept = exact_dedup.without_duplicates(odd, keep="max")
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.select("text").collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in odd_rows})
    assert exact_dedup.without_duplicates(none).count() == 0


def brute_passages(rows: list[tuple], n: int = 50) -> list[tuple]:
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone: set[int] = set()
        for i in range(len(w) - n + 1):
            if d is not None and least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def _passages(docs, n: int = 50) -> list[tuple]:
    every, changed = substring_dedup.repeated_passages(docs, n)
    texts = {r.mark: " ".join(WORD.findall(r.text or "")) for r in docs.selectExpr("xxhash64(text) mark", "text").collect()}
    new = {(r.doc_id, r.mark): r for r in changed.collect()}
    return [(r.doc_id, r.n_words, c.n_removed, c.kept) if (c := new.get((r.doc_id, r.mark))) else (r.doc_id, r.n_words, 0, texts[r.mark]) for r in every.collect()]


def test_passages(odd, odd_rows):
    # Rows that share an id are one document, so their windows are judged together; here they are short.
    want = brute_passages([(r[0], r[1]) for r in odd_rows])
    assert sorted(map(str, _passages(odd))) == sorted(map(str, want))


def test_passages_of_other_lengths(spark, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows[:40] if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (2, 12, 33):
        assert sorted(map(str, _passages(docs, n))) == sorted(map(str, brute_passages(rows, n)))


def test_passages_of_rows_that_share_an_id(spark):
    """Two long texts and a short one under one id: pieces are read from, and removed in, the text they were found in."""
    text = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    shared, other = text("s", 90), text("o", 80)
    rows = [(1, f"{text('a', 20)} {shared}"), (1, f"{other} {text('b', 300)}"), (1, "a short one"), (2, f"{text('c', 7)} {shared} {text('d', 9)}"), (3, f"{text('e', 130)} {other}"), (3, text("f", 210)), (3, f"{shared} {text('g', 60)}"), (3, "short too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(str, _passages(docs))) == sorted(map(str, brute_passages(rows)))


def test_without_repeats(odd, none):
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    by = {r.doc_id: r for r in out.collect()}
    assert 9 not in by and by[8].n_chars == len(by[8].text)  # a whole copy goes, its first stays
    assert by[2].text == "   \n\t "  # what loses nothing stays as it is
    assert substring_dedup.without_repeats(none).count() == 0


def test_index_reports_smallest_owner():
    import numpy as np

    rng = np.random.default_rng(5)
    for depth in (2, 3, 8, 17, 50):
        base = rng.integers(0, 4, 300)
        texts = [base[o : o + n].copy() for o, n in zip(rng.integers(0, 200, 40), rng.integers(0, 90, 40), strict=True)]
        owner = rng.permutation(40)
        index = fm_index.FMIndex(np.concatenate(texts), np.array([len(t) for t in texts]), owner, depth)
        got = index.matches()
        least: dict[tuple, int] = {}
        for t, o in zip(texts, owner, strict=True):
            for i in range(len(t) - depth + 1):
                least[tuple(t[i : i + depth])] = min(least.get(tuple(t[i : i + depth]), 10**9), o)
        for t, s in zip(texts, index.starts, strict=True):
            for i in range(len(t) + 1):
                assert got[s + i] == (least[tuple(t[i : i + depth])] if i + depth <= len(t) else -1)


def test_crowded_anchors(spark, odd_rows, monkeypatch):
    """Pieces of anchors that many share are dealt by longer grams and then by windows, with the same result."""
    rows = [(r[0], r[1]) for r in odd_rows[:40] if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (0, 1, 3):
        monkeypatch.setattr(substring_dedup, "CROWD", crowd)
        assert sorted(map(str, _passages(docs))) == sorted(map(str, brute_passages(rows)))


def test_a_line_in_many_surroundings(spark, monkeypatch):
    """A line of 60 words that every document has, between words of its own or of a neighbour's: most pieces differ, some windows don't."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(50)}"
    line = " ".join(f"line{i}" for i in range(60))
    sides = [(" ".join(word() for _ in range(40)), " ".join(word() for _ in range(40))) for _ in range(30)]
    rows = [(i, f"{sides[i % 30][0]} {line} {sides[(i * 7) % 30][1]}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, brute_passages(rows)))
    for crowd in (2, 10, 256):
        monkeypatch.setattr(substring_dedup, "CROWD", crowd)
        assert sorted(map(str, _passages(docs))) == want
