"""What operators on pairs leave on disk, and how full their sketch gets."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np

from loamfield.llm import ngram_jaccard, shared
from loamfield.llm.shared import passing, written


def test_full_sketch_still_tells_frequent_tokens_apart():
    """Counters that several hundred rare tokens share do not make those tokens frequent."""
    total = np.random.default_rng(5).poisson(370, 1 << 16).astype(np.uint64)
    total[:50] += np.uint64(2000)
    classes = np.frombuffer(ngram_jaccard._classes(0, total).column("classes")[0].as_buffer(), np.uint8)
    often = classes >= 2 * np.log2(ngram_jaccard.FREQUENT)
    assert often[:50].all() and not often[50:].any()


def test_sketch_grows_with_the_text():
    sizes = [ngram_jaccard.sketch_bits(n) for n in (0, 1, 208 << 22, (208 << 22) + 1, 208 << 24, 1 << 50)]
    assert sizes == [22, 22, 22, 23, 24, 25]


def test_sketch_of_any_size_counts_alike(spark, monkeypatch):
    """Over a sketch of more bits and over runs of a few tokens, the common tokens are the same."""
    docs = spark.createDataFrame([(i, f"a b c d e own{i} f{i} g{i} h{i} i{i}") for i in range(300)], "doc_id long, text string")
    for least in (22, 24):
        monkeypatch.setattr(ngram_jaccard, "SKETCH_BITS", least)
        monkeypatch.setattr(ngram_jaccard, "_RUN", 64)
        classes = ngram_jaccard.token_classes(docs, 5)
        assert len(classes) == 1 << least and int((classes >= 16).sum()) == 1 and int(classes.max()) == 17


def test_tables_between_steps_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    left = lambda: {p.name.rsplit("-", 1)[0] for p in Path(tmp_path, "loamfield").iterdir()}
    with passing(spark):
        with passing(spark):
            written(spark.range(3), "inner")
            kept = written(spark.range(3), "outer", lasting=True)
        assert left() == {"outer"} and kept.count() == 3
        written(spark.range(3), "stage", lasting=True)
    assert left() == {"stage"}
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(20)], "doc_id long, text string")
    assert ngram_jaccard.similarity_components(docs).count() == 20
    assert left() == {"stage", "index", "links", "components"}


def test_shuffle_files_go_with_the_write(spark):
    """Before the driver collects its garbage."""
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    before = files()
    written(spark.range(20_000).groupBy("id").count(), "counts")
    for _ in range(50):  # they go in the background
        if files() - before:
            time.sleep(0.1)
    assert not files() - before
