from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loamfield.operators import agreement, association, coding, comparison, coverage, hierarchy, lifecycle, preprocess, quotes, themes
from loamfield.sinks import exports
from loamfield.sources import codebooks, config, ingest, manuscripts, runs


def _pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_collisions_get_their_table(spark):
    a = spark.createDataFrame([("x1", "one"), ("x2", "two")], "id string, text string")
    entries = {t: ingest.standardised(a, ingest.detected_columns(a.columns)) for t in ("posts", "comments")}
    assert _pairs(ingest.combined(entries), "std_id") == [("comments:x1",), ("comments:x2",), ("posts:x1",), ("posts:x2",)]
    twice = ingest.standardised(a.union(a), ingest.detected_columns(a.columns))
    with pytest.raises(ValueError):
        ingest.combined({"posts": twice})


def test_columns(spark):
    assert ingest.detected_columns(["Body", "Post_ID", "Author"], "reddit") == {"id": "Post_ID", "text": "Body", "author": "Author", "timestamp": None}
    with pytest.raises(ValueError):
        ingest.detected_columns(["a"], "reddit")
    posts = spark.createDataFrame([("a", "t", 1_700_000_000.0, 3)], "post_id string, text string, created_utc double, score int")
    row = ingest.standardised(posts, ingest.detected_columns(posts.columns, "reddit")).first()
    assert (row.std_timestamp, row.score, row.std_author) == ("2023-11-14 22:13:20", 3.0, None)
    assert ingest.picked_table({"metadata": posts, "posts": posts}) == "posts"


def test_preprocessing_keeps_the_first(spark):
    rows = spark.createDataFrame([("b", "same text  here", 2), ("a", "same text here", 1), ("c", "short", 3), ("d", None, 4), ("e", "  ", 5)], "std_id string, std_text string, row_ord long")
    assert _pairs(preprocess.preprocessed(rows), "std_id", "std_text") == [("a", "same text here")]
    assert preprocess.preprocessed(rows.limit(0)).count() == 0


def test_threads(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("b", "a", "y"), ("c", "b", "[deleted]"), ("d", "c", "z"), ("e", "a", None)], "id string, parent string, text string")
    assert _pairs(ingest.flattened_threads(rows, "id", "parent", "text"), "node", "depth") == [("a", 0), ("b", 1), ("e", 1)]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "id long, next long")
    assert _pairs(ingest.expanded(spark.createDataFrame([(1,)], "id long"), links), "id") == [(1,), (2,), (3,)]


def test_membership(spark):
    entries = spark.createDataFrame([("1",), ("2",), ("3",)], "std_id string")
    codes = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a"), ("9", "z")], "std_id string, code_key string")
    book = spark.createDataFrame([("a", "T"), ("b", "T"), ("b", "U")], "code_key string, theme string")
    members = themes.cascade(codes, book)
    assert _pairs(members, "std_id", "theme", "n_codes") == [("1", "T", 2), ("1", "U", 1), ("2", "T", 1)]
    wide = themes.wide(entries, members, ["T", "U"])
    assert _pairs(wide, "std_id", "theme_membership_T", "theme_membership_U") == [("1", 1, 1), ("2", 1, 0), ("3", 0, 0)]
    assert _pairs(themes.long(wide), "std_id", "theme") == [("1", "T"), ("1", "U"), ("2", "T")]


def test_spread(spark):
    rows = spark.createDataFrame([("t", "a")] * 3 + [("t", "b"), ("t", None), ("t", " "), ("s", "a")], "theme string, author string")
    got = {r.theme: (r.n_contributors, r.n_entries, r.top_share, r.gini) for r in themes.spread(rows, "author", ["theme"]).collect()}
    assert got == {"t": (2, 4, 0.75, pytest.approx(0.25)), "s": (1, 1, 1.0, None)}
    assert {r.theme: r.warning for r in themes.spread_warning(themes.spread(rows, "author", ["theme"])).collect()} == {"t": "dominant_contributor", "s": "single_contributor"}


def test_quotes_of_different_authors(spark):
    rows = spark.createDataFrame([("t", str(i), "x" * 60, float(i), "a" if i < 4 else f"b{i}") for i in range(7)], "theme string, std_id string, std_text string, s double, author string")
    assert [r.std_id for r in themes.extreme_quotes(rows, "s", "std_id").orderBy("s").collect()] == ["0", "3", "6"]
    got = {r.position: r.std_id for r in themes.spread_quotes(rows, "s", "std_id", "author").collect()}
    assert got == {"most_negative": "0", "median": "4", "most_positive": "6"}


def test_quotes_of_authors_far_off(spark):
    """However many entries of a quoted author stand next to a target, as a search over all rows says."""
    n = 1500
    themes_ = {
        "far": ["a"] * n,
        "alone": ["a"] * n,
        "nobody": [None if i % 2 else "" for i in range(n)],
        "single": ["a"] * n,
        "mixed": ["a" if i < 900 else "b" if i < 1490 else "a" for i in range(n)],
    }
    themes_["far"][1200], themes_["far"][240] = "b", "c"
    themes_["alone"][3], themes_["alone"][1100] = None, ""
    rows = spark.createDataFrame([(t, f"{i:05d}", "x" * 60, float(i), a) for t, v in themes_.items() for i, a in enumerate(v)], "theme string, std_id string, std_text string, s double, author string")
    got = {(r.theme, r.position): (int(r.std_id), r.place) for r in themes.spread_quotes(rows, "s", "std_id", "author").collect()}
    want = {}
    for t, authors in themes_.items():
        taken, quoted = set(), set()
        for label, target in (("most_negative", 0), ("median", n // 2 - 1), ("most_positive", n - 1)):
            ring = [target, *(i for d in range(1, n) for i in (target - d, target + d) if 0 <= i < n)]
            at = next((i for i in ring if i not in taken and (not authors[i] or authors[i] not in quoted)), target)
            taken.add(at)
            quoted |= {authors[at]} - {None, ""}
            want[t, label] = (at, at + 1)
    assert got == want


def test_quote_steps(spark):
    source = "Hello world. This is the source text."
    rows = spark.createDataFrame(
        [(1, source, "This is the so", 13, 27, False), (2, source, "this  is the so", 13, 27, False), (3, source, "HELLO WORLD", 500, 511, False), (4, source, "made up words", 0, 13, False), (5, source, "made up words", 0, 13, True), (6, source, "  ", 0, 2, False), (7, None, "x", 0, 1, False)],
        "id int, source_text string, exact_text string, start_char int, end_char int, old boolean",
    ).withColumn("source_sha256", F.sha2(F.when(F.col("old"), "other").otherwise(F.coalesce("source_text", F.lit(""))), 256))
    got = {r.id: (r.status, r.method, r.score, r.failure_reason) for r in quotes.verified(rows).collect()}
    assert got[1] == ("verified_exact", "string_match", 1.0, None)
    assert got[2][:3] == ("verified_fuzzy", "normalized_match", 0.95) and got[3][:2] == ("verified_fuzzy", "substring_search")
    assert got[4] == ("fabricated", None, None, "step3_substring_not_found")
    assert got[5] == ("drifted", None, None, "source_text_sha256_mismatch")
    assert got[6][3] == "step3_target_empty_after_normalization" and got[7] == ("drifted", None, None, "source_missing_from_corpus")


def test_coverage(spark):
    entries = spark.createDataFrame([(str(i), "a b") for i in range(5)], "std_id string, std_text string")
    results = spark.createDataFrame([("0", False, 3, False), ("1", True, 0, False), ("2", False, 3, True)], "std_id string, skipped boolean, chars_sent int, truncated boolean")
    codes = spark.createDataFrame([("0", "x"), ("2", "")], "std_id string, code_key string")
    r = coverage.coverage(entries, results, codes, stopped_at=3).first()
    assert (r.n_processed, r.n_unprocessed, r.n_skipped, r.n_coded, r.n_examined_no_codes, r.words_processed) == (3, 2, 1, 1, 1, 6)
    assert r.no_silent_truncation and r.truncation_tracked and r.n_entries_truncated == 1
    assert not coverage.coverage(entries, results, codes).first().no_silent_truncation
    assert coverage.coverage(entries.limit(0), results, codes).first().coverage_rate is None


def test_correlations_in_rank(spark):
    rows = spark.createDataFrame([(float(i), float(i * i), i % 2, None if i % 5 else 1.0) for i in range(40)], "a double, b double, c int, d double")
    got = {(r.var1, r.var2): r for r in association.correlations(rows, ["a", "b", "d"], "spearman").collect()}
    assert got[("a", "b")].r == pytest.approx(1) and got[("a", "b")].p < 1e-12 and got[("a", "d")].r is None and got[("a", "d")].n == 8
    kinds = {r.variable: r.kind for r in association.variable_types(rows, ["a", "c"]).collect()}
    assert kinds == {"a": "continuous", "c": "binary"}
    assert association.usable_columns(rows, ["a", "d"], ["c"]) == ["a", "c"]
    marked = association.significant(association.correlations(rows, ["a", "b", "c"]), ["a", "b"]).collect()
    assert {(r.var1, r.var2): r.p_bh is None for r in marked} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}


def test_group_comparison(spark):
    rows = spark.createDataFrame([("t", int(i >= 10), float(i)) for i in range(20)], "theme string, m int, x double")
    r = association.group_comparison(rows, "theme", "m", ["x"]).first()
    assert (r.u, r.effect_r, r.direction) == (100, 1, "Higher in theme") and r.p == pytest.approx(0.0001827, rel=1e-3)


def test_cooccurrence(spark):
    entries = spark.createDataFrame([(i,) for i in range(40)], "std_id long")
    members = spark.createDataFrame([(i, "a") for i in range(20)] + [(i, "b") for i in range(10, 30)] + [(0, "c")], "std_id long, theme string")
    r = association.cooccurrence(entries, members).collect()
    assert len(r) == 1 and (r[0].n_both, r[0].test, r[0].statistic, r[0].p) == (10, "chi_square", 0, 1)


def test_agreement(spark):
    same = spark.createDataFrame([(i % 2, i % 2) for i in range(10)], "a int, b int")
    assert agreement.kappa(same, "a", "b").first().kappa == 1
    assert agreement.kappa(spark.createDataFrame([(1, 0), (0, 1)] * 4, "a int, b int"), "a", "b").first().kappa < 0
    sets = spark.createDataFrame([(["x"], ["x"]), (["y"], ["y"]), (["x", "y"], ["x"]), ([], [])], "a array<string>, b array<string>")
    assert agreement.percent_agreement(sets).first().n_agree == 3
    assert agreement.set_alpha(sets.limit(1)).first().alpha is None and 0 < agreement.set_alpha(sets).first().alpha < 1
    assert agreement.canonical_labels(["stress", "stresss", "joy"]) == {"stress": "stress", "stresss": "stress", "joy": "joy"}
    many = sets.crossJoin(spark.range(5)).select("a", "b")
    r = agreement.bootstrap_alpha(many, 50).first()
    assert r.n == 20 and r.lower <= r.upper and agreement.bootstrap_alpha(sets, 50).first().lower is None
    sheet = agreement.coding_sheet(spark.createDataFrame([("1",), ("2",)], "std_id string"), spark.createDataFrame([("1", "B"), ("1", "a")], "std_id string, code string"), 3)
    assert _pairs(agreement.sheet_sets(sheet), "std_id", "labels") == [("1", ["b", "a"]), ("2", [])]


def test_code_matching(spark):
    now = spark.createDataFrame([("sleep quality",), ("work stress",), ("diet",)], "code_text string")
    then = spark.createDataFrame([("sleep quality",), ("work stres",), ("zzz",)], "code_text string")
    got = {(r.code_prev, r.code_curr): r.status for r in comparison.code_changes(now, then).collect()}
    assert got == {("sleep quality", "sleep quality"): "stable", ("work stres", "work stress"): "stable", (None, "diet"): "new", ("zzz", None): "dropped"}
    r = comparison.code_stability(comparison.code_changes(now, then)).first()
    assert (r.n_stable, r.n_new, r.n_dropped, r.jaccard, r.churn_rate) == (2, 1, 1, 0.5, 0.5)


def test_runs_compared(spark):
    listed = spark.createDataFrame([("run_1", "1.0", "p", "m"), ("run_2", "2.0", "p", "m"), ("run_3", "1.1", "p", "n"), ("run_4", "1.1", "p", "n")], "run_id string, schema_version string, provider string, model string")
    assert _pairs(comparison.current_and_previous(listed), "run_id", "role") == [("run_3", "previous"), ("run_4", "current")]
    assert _pairs(comparison.cross_model_pair(listed), "run_id", "role") == [("run_2", "previous"), ("run_4", "current")]


def test_partitions(spark):
    leaves = spark.createDataFrame([(i, [f"c{i}"]) for i in range(1, 5)], "leaf long, codes array<string>")
    proposal = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (2, 2), (3, 77)], "cluster long, leaf long")
    mended = hierarchy.normalised_partition(proposal, leaves)
    assert _pairs(mended, "cluster", "leaf") == [(1, 1), (1, 3), (2, 2), (3, 4)]
    assert _pairs(hierarchy.applied_partition(leaves, mended), "cluster", "codes") == [(1, ["c1", "c3"]), (2, ["c2"]), (3, ["c4"])]
    done, passes = hierarchy.multipass(leaves, lambda _, n: proposal if n == 1 else None)
    assert passes == 1 and done.count() == 3


def test_trees(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", None), ("x", None, "X")], "node_id string, parent_id string, name string")
    tree = hierarchy.paths(nodes)
    assert _pairs(tree, "node", "depth") == [("a", 1), ("b", 2), ("c", 3), ("x", 1)]
    refs = spark.createDataFrame([("c", "s1"), ("b", "s1"), ("x", "s2")], "node string, source string")
    assert _pairs(hierarchy.rolled_up(refs, tree), "node", "n_refs", "n_sources") == [("a", 2, 1), ("b", 2, 1), ("c", 1, 1), ("x", 1, 1)]
    with pytest.raises(ValueError):
        hierarchy.paths(spark.createDataFrame([("r", None, "r"), ("a", "r", "a"), ("b", "a", "b"), ("c", "b", "c")], "node_id string, parent_id string, name string"), most_depth=2)
    names = hierarchy.unique_names(spark.createDataFrame([(1, "T"), (2, "t"), (3, "U")], "theme_id int, name string"))
    assert _pairs(names, "name") == [("T",), ("U",), ("t (2)",)]


def test_fold(spark):
    entries = spark.createDataFrame([(str(i), f"text about thing {i % 3} here", i) for i in range(9)] + [("s", "short", 9)], "std_id string, std_text string, row_ord long")
    coder = lambda rows, book: [{"std_id": r["std_id"], "code_key": r["std_text"][11:18]} for r in rows]
    segments, book, state = coding.fold(entries, coder)
    assert len(segments) == 9 and book == ["thing 0", "thing 1", "thing 2"] and state["stopped"] is None and state["n_seen"] == 10
    assert coding.fold(entries, coder, until=lambda births: births[-2:] == [0, 0])[2]["stopped"] == "saturation"

    def broken(rows, book):
        raise RuntimeError

    assert coding.fold(spark.range(30).selectExpr("string(id) std_id", "'long enough text' std_text", "id row_ord"), broken)[2] == {"n_seen": 10, "n_failed": 10, "stopped": "failures"}


def test_batches(spark):
    rows = spark.createDataFrame([("g", i, "x" * (40 if i else 4000)) for i in range(5)], "g string, i long, std_text string")
    got = _pairs(coding.batches(rows, "i", "g", tokens=210, rows=3), "i", "batch")
    assert got == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)] or got[0] == (0, 1)


def test_review(spark):
    segments = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "std_id string, code_key string")
    edits = spark.createDataFrame([("a", "delete", None), ("b", "merge", "c"), ("d", "split", "e")], "code_key string, action string, target string")
    assert _pairs(coding.reviewed_codes(segments, edits), "std_id", "code_key") == [("2", "c"), ("3", "c"), ("4", "d"), ("4", "e")]


def test_codebook_files(spark):
    book = codebooks.codebook(spark, [{"Code": "Health: Sleep", "Grounded": "12", "Comment": "c"}, {"Code": "Diet", "Grounded": "3"}])
    assert _pairs(book, "code", "parent", "frequency") == [("Diet", None, 3), ("Sleep", "Health", 12)]
    nested = codebooks.codebook(spark, [{"name": "Top"}, {"name": "  Mid"}, {"name": "    Low"}, {"name": "A::B"}])
    assert {r.code: (r.parent, r.level) for r in nested.collect()} == {"Top": (None, 1), "Mid": ("Top", 2), "Low": ("Mid", 3), "B": ("A", 2)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Code</t></si><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>count</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4</v></c></row></sheetData></worksheet>')
    assert codebooks.xlsx_rows(out.getvalue()) == [{"Code": "x", "count": "4"}]


def test_projects_are_read_back(spark):
    entries = spark.createDataFrame([("1", "some <text> & more\x01")], "std_id string, std_text string")
    segments = spark.createDataFrame([("1", "k", 0, 4)], "std_id string, code_key string, start_char int, end_char int")
    data = exports.qdpx(entries, segments, spark.createDataFrame([("k", "Code K")], "code_key string, name string"))
    codes, sources, refs = codebooks.qdpx(spark, data)
    assert codes.first()["name"] == "Code K" and sources.first()["text"] == "some <text> & more"
    assert refs.join(codes, "guid").select("start_char", "end_char").first()[:] == (0, 4)


def test_sections(spark, tmp_path):
    (tmp_path / "a.md").write_text("title\n# Abstract\nshort\n## 2. Methods\nwe did\nmore\nAbstract\nagain")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Results</w:t></w:p><w:p><w:t>found </w:t><w:t>it</w:t></w:p></w:document>')
    rows = manuscripts.sections(manuscripts.documents(spark, str(tmp_path)))
    assert _pairs(rows, "section", "text") == [("abstract", "short\nagain"), ("methods", "we did\nmore"), ("results", "found it")]


def test_run_folders(spark, tmp_path):
    folder = tmp_path / "run_2026-01-01_120000_M2"
    folder.mkdir()
    (folder / "sentiment_scores.csv").write_text('# methodology: M2\nstd_id,std_text,sentiment_score,all_emotions,emotion_intensity,confidence,emerged_themes,source_table\n1,"a, b",0.5,joy,1,1,T,posts\n')
    (folder / "themes.json").write_text(exports.stamped_json([{"name": "T", "entry_count": 3, "codes_included": "a; b"}], {"mode": "M2"}))
    (folder / "run_metadata.json").write_text('{"provider": "p", "model_primary": "m", "analysis_schema_version": "1.0"}')
    base = str(tmp_path)
    assert runs.sentiment(spark, base).select("run_id", "std_text", "sentiment_score").first()[:] == ("run_2026-01-01_120000_M2", "a, b", 0.5)
    assert runs.themes(spark, base).select("name", "entry_count", "codes").first()[:] == ("T", 3, ["a", "b"])
    assert runs.listed(spark, base).select("run_id", "compatible").first()[:] == ("run_2026-01-01_120000_M2", True)
    assert exports.stamped_csv(exports.stamped_csv("a,b\n", "one"), "two") == "# methodology: two\na,b\n"
    assert exports.missing_artifacts([p.name for p in folder.iterdir()]) == ["codes.csv", "correlations.csv"]


def test_checkpoints(spark, tmp_path):
    folder = str(tmp_path)
    assert runs.latest_checkpoint(spark, folder, "s") is None
    exports.checkpoint(spark.range(1), folder, "s", partial=True)
    assert runs.latest_checkpoint(spark, folder, "s").count() == 1
    exports.checkpoint(spark.range(2), folder, "s")
    assert runs.latest_checkpoint(spark, folder, "s").count() == 2 and not (tmp_path / "s.partial").exists()


def test_logs_and_memos(spark, tmp_path):
    log = spark.createDataFrame([("t", "coding", "new_code", "m")], "timestamp string, step string, decision_type string, model string")
    exports.appended_log(log, str(tmp_path / "log"))
    row = runs.audit_log(spark, str(tmp_path / "log")).first()
    assert (row.step, row.extras) == ("coding", {"model": "m"})
    with pytest.raises(Exception, match="unknown step"):
        exports.log_rows(log.withColumn("step", F.lit("other"))).collect()
    (tmp_path / "m.md").write_text("---\ntype: analytic\nauthor: A\nthemes: [T, U]\n---\nbody\n")
    notes = runs.memos(spark, str(tmp_path / "m.md"))
    assert lifecycle.memos(notes, "analytic", theme="U").first()["body"] == "body" and lifecycle.memos(notes, author="B").count() == 0


def test_lifecycle(spark):
    log = spark.createDataFrame([("r", 1, "open", "m"), ("r", 2, "finalized", "m"), ("r", 3, "open", "m"), ("q", 1, "open", "n")], "run_id string, ts int, state string, mode string")
    assert _pairs(lifecycle.states(log), "run_id", "state") == [("q", "open"), ("r", "finalized")]
    assert lifecycle.mismatch("a", "b", True) == "fork_required"
    table = spark.createDataFrame([("r", "m", "finalized")], "run_id string, mode string, state string")
    assert _pairs(lifecycle.forked(table, "r", "s", "n"), "run_id", "mode", "state") == [("r", "m", "finalized"), ("s", "n", "open")]
    names = spark.createDataFrame([("T",), ("U",)], "theme string")
    kinds = spark.createDataFrame([("x",), ("y",)], "category string")
    done = spark.createDataFrame([("T", "x")], "theme string, category string")
    assert _pairs(lifecycle.open_questions(names, kinds, done, done.limit(0)), "theme", "category") == [("T", "y"), ("U", "x"), ("U", "y")]


def test_settings(spark):
    out = config.loaded('{"analysis": {"min_theme_entries": 9}}', {"comparison.threshold": 0.5})
    assert out["analysis"]["min_theme_entries"] == 9 and out["comparison"]["threshold"] == 0.5 and out["data"]["seed"] == 42
    with pytest.raises(ValueError):
        config.loaded("{}", {"analysis.mode": "x"})
    spec = {"name": "f", "stance": "realist", "anomaly_policy": "bracket", "constructs": [{"id": "a"}, {"id": "b", "indicators": ["x"]}]}
    assert config.framework(spark, spec).count() == 2
    with pytest.raises(ValueError):
        config.framework(spark, spec | {"constructs": [{"id": "a"}, {"id": "a"}]})


def test_inserts_are_idempotent(spark, tmp_path):
    from loamfield.streaming import live

    folder, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").write.parquet(str(folder / "p1"))
    for n in (1, 2):
        stream = spark.readStream.schema("id long, v string").option("recursiveFileLookup", "true").parquet(str(folder))
        live.inserts(stream, "id", target, str(tmp_path / f"cp{n}")).awaitTermination()
        assert spark.read.parquet(target).count() == 2


def test_analysis_end_to_end(spark, sf_dir):
    from loamfield.plans import analysis

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = [("the", r"\bthe\b"), ("und", r"\bund\b"), ("les", r"\bles\b")]
    codes = spark.createDataFrame([("the", "english"), ("und", "german"), ("les", "french")], "code_key string, theme string")
    score = lambda e: e.select("std_id", (F.length("std_text") % 5 - 2.0).alias("sentiment_score"), F.lit(2.0).alias("confidence"), F.lit(None).cast("double").alias("emotion_intensity"), F.array(F.lit("joy")).alias("emotions"))
    out = analysis.analysed(spark, {"documents": docs}, lambda e: coding.pattern_segments(e, rules), codes, score, config.loaded("{}", {"data.source_type": "generic"}))
    assert out["coverage"].first().n_duplicate_ids == 0 and out["statistics"].count() == 3
    assert out["sentiment"].agg(F.max("confidence"), F.max("sentiment_score")).first()[:] == (1.0, 1.0)
    assert {r.group for r in out["groups"].collect()} <= {"english", "german", "french"}
    grid = analysis.scaffold(out["entries"], out["membership"], ["x", "y"], spark.createDataFrame([("english", "x", 2)], "theme string, category string, n_emitted long"), spark.createDataFrame([("german", "y")], "theme string, category string"))
    assert grid["open"].count() == 4 and grid["grid"].where("status = 'silent_skip'").count() == 4


def test_two_runs_compared(spark, tmp_path):
    from loamfield.plans import analysis

    for day, theme in (("01", "Sleep"), ("02", "Sleeping")):
        folder = tmp_path / f"run_2026-01-{day}_120000"
        folder.mkdir()
        (folder / "sentiment_scores.csv").write_text(f"std_id,std_text,sentiment_score,all_emotions,emotion_intensity,confidence,emerged_themes,source_table\n1,a,0.{day},joy; fear,1,1,{theme},posts\n{day},b,0.5,joy,1,1,{theme},posts\n")
        (folder / "codes.csv").write_text("code_key,code_text,code_type,frequency,n_entries\nk,sleep,d,1,1\n")
        (folder / "correlations.csv").write_text("var1,var2,correlation,p_value,effect_size,significant,ci_lower,ci_upper\na,b,0.5,0.01,large,TRUE,0.1,0.9\n")
        (folder / "themes.json").write_text(exports.stamped_json([{"name": theme, "entry_count": 2, "codes_included": "sleep"}], {}))
        (folder / "run_metadata.json").write_text('{"provider": "p", "model_primary": "m' + day + '", "analysis_schema_version": "1.1"}')
    for models in (False, True):
        out = analysis.compared(spark, str(tmp_path), models)
        assert out["samples"].first().n_shared == 1 and out["themes"].first().status == "persisted"
        assert out["stability"].first().n_stable == 1 and out["codes"].first().status == "stable"
        assert out["correlations"].first().status == "persistent" and out["timeline"].count() == 2
