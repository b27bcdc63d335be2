"""License scans by diagonal voting, with DataFrame operations only.

All rolling k-word grams of every text are hashed and joined with the places of the same
grams in license templates, a fixed table.  A match of a gram at text place i and template
place j votes for diagonal i - j.  Votes are aggregated by diagonal; neighbouring diagonals,
which an inserted or missing word makes, are merged; and the words of every gram that votes
are compared with the template's, so a span never rests on hashes.

A phrase is a short template that counts only when all of its grams vote for one diagonal,
that is where its words stand consecutively.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import MOST_SENT, written

#: Words of a gram of phrases and of templates.
PHRASE_GRAM, TEMPLATE_GRAM = 2, 4
#: Diagonals of one template at most so far apart are one span; share of a template's grams that makes a span a find.
NEIGHBOURS, LEAST_SHARE = 3, 0.6
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEADER = -4611686018427387904


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def gram(self) -> int:
        return PHRASE_GRAM if self.exact else TEMPLATE_GRAM

    @property
    def grams(self) -> list[str]:
        w, k = self.words, self.gram
        return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


PHRASES = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))

#: Short notices by which licenses are named, and first words of their texts, lower-cased without punctuation.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-3", "either version 3 of the license or at your option any later version"),
    Template("lgpl", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Runs of characters outside 0x00-0x2F, 0x3A-0x40, 0x5B-0x60 and 0x7B-0x7F, case as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` puts it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(words: Column) -> Column:
    """Hashes of every PHRASE_GRAM consecutive words, then of every TEMPLATE_GRAM; a word is hashed once, and words that differ in A-Z only hash alike.

    A longer gram's hash is made from those of its two halves.
    """

    def rolling(each: Column, apart: int) -> Column:
        last = F.size(each) - apart
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.element_at(each, i), F.element_at(each, i + apart)))

    once = F.transform(words, lambda w: F.xxhash64(F.lower(w)))
    return _bound(_bound(once, lambda each: rolling(each, 1)), lambda halves: F.concat(halves, rolling(halves, PHRASE_GRAM)))


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(hash, template, place, gram, k) of every gram of the templates, and a row for the header of each text."""
    rows = [(t, j, g, x.gram, g.split()) for t, x in enumerate(templates) for j, g in enumerate(x.grams)]
    one = (F.struct(F.lit(t).alias("template"), F.lit(j).alias("place"), F.lit(g).alias("gram"), F.lit(k).alias("k"), F.array(*map(F.lit, w)).alias("words")) for t, j, g, k, w in rows)
    listed = spark.range(1).select(F.inline(F.array(*one)))
    hashed = listed.select(F.element_at(_hashes(F.col("words")), -1).alias("hash"), "template", "place", "gram", "k")
    header = spark.range(1).select(F.lit(_HEADER).cast("long").alias("hash"), F.lit(-1).alias("template"), F.lit(0).alias("place"), F.lit("").alias("gram"), F.lit(0).alias("k"))
    return hashed.unionByName(header)


def _verified(texts: DataFrame, votes: DataFrame) -> DataFrame:
    """Headers, and of the votes of texts that have some those whose words are the gram's."""
    voted = votes.where("template >= 0").groupBy("doc_id", "mark", "n_words").agg(F.collect_set(F.struct("template", "diagonal", "vote")).alias("votes"))
    voted = written(voted.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n_words", "votes"), "voted")
    ids = voted.select("_id", "_mark")
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    few = texts.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, here, "left_semi").join(voted, here)
    said = lambda words, v: _lower(F.concat_ws(" ", F.slice(words, v["vote"]["at"] + 1, v["vote"]["k"])))
    right = _bound(words_of(F.col("text")), lambda words: F.filter(F.col("votes"), lambda v: said(words, v) == v["vote"]["gram"]))
    found = few.select("doc_id", "mark", "n_words", F.explode(right).alias("v")).select("doc_id", "mark", "n_words", "v.template", "v.diagonal", F.col("v.vote.place").alias("place"))
    header = votes.where("template < 0").select("doc_id", "mark", "n_words", "template", F.lit(None).cast("int").alias("diagonal"), "place")
    return header.unionByName(found)


def scanned(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``docs`` (doc_id, text, anything else).

    n_base counts the places of exact phrases, first_word and last_word are the smallest and
    largest of their starts (null without any), base_labels and labels the distinct labels
    found, sorted and comma-joined (empty without any), score the largest share of a
    template's grams that one span has.  Null and empty texts have no words; a very long one
    costs in proportion to its length.  Rows that repeat
    doc_id and text are returned as often.
    """
    if any(len(t.grams) > 62 or not t.grams for t in templates):
        raise ValueError("a template has 1 to 62 grams")
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = texts.select("doc_id", "mark", words_of(F.col("text")).alias("words")).select("doc_id", "mark", F.size("words").alias("n_words"), "words")
    every = F.concat(F.array(F.lit(_HEADER).cast("long")), _hashes(F.col("words")))
    placed = rows.select("doc_id", "mark", "n_words", F.posexplode(every).alias("i", "hash"))  # places only: a text of a million words is not copied for each
    twos = F.greatest(F.col("n_words") - (PHRASE_GRAM - 1), F.lit(0))
    k = F.when(F.col("i") == 0, 0).when(F.col("i") <= twos, PHRASE_GRAM).otherwise(TEMPLATE_GRAM)
    at = F.when(F.col("k") == PHRASE_GRAM, F.col("i") - 1).otherwise(F.col("i") - 1 - twos)
    votes = placed.join(F.broadcast(template_grams(spark, templates)), "hash").where(k == F.col("k"))
    votes = votes.select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words"), "template", F.struct(at.alias("at"), "place", "k", "gram").alias("vote"))
    votes = written(votes, "votes").select("*", (F.col("vote.at") - F.col("vote.place")).alias("diagonal"), F.col("vote.place").alias("place"))
    votes = _verified(texts, votes)
    by = ["doc_id", "mark", "n_words"]
    diagonals = votes.groupBy(*by, "template", "diagonal").agg(F.expr("bit_or(shiftleft(1L, place))").alias("places"), F.count("*").alias("rows"))
    order = W.partitionBy(*by, "template").orderBy("diagonal")
    exact = [i for i, t in enumerate(templates) if t.exact]
    merged = F.col("diagonal") - F.lag("diagonal").over(order) <= F.when(F.col("template").isin(exact), 0).otherwise(NEIGHBOURS)
    spans = (
        diagonals.withColumn("new", F.when(merged, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(order))
        .groupBy(*by, "template", "span")
        .agg(F.min("diagonal").alias("first"), F.expr("bit_count(bit_or(places))").alias("votes"), F.max("rows").alias("rows"))
    )

    def of(values: list) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.greatest(F.col("template"), F.lit(0)) + 1)

    share = F.when(F.col("template") >= 0, F.col("votes") / of([float(len(t.grams)) for t in templates])).otherwise(0.0)
    spans = spans.withColumns({"share": share, "label": of([t.label for t in templates]), "exact": of([t.exact for t in templates])})
    base, found = "template >= 0 AND exact AND share = 1.0", f"template >= 0 AND share >= IF(exact, 1.0, {LEAST_SHARE})"
    out = spans.groupBy(*by).agg(
        F.count(F.expr(f"CASE WHEN {base} THEN 1 END")).alias("n_base"),
        F.min(F.expr(f"CASE WHEN {base} THEN first END")).cast("long").alias("first_word"),
        F.max(F.expr(f"CASE WHEN {base} THEN first END")).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.expr(f"CASE WHEN {base} THEN label END"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.expr(f"CASE WHEN {found} THEN label END"))), ",").alias("labels"),
        F.max(F.expr("IF(exact AND share < 1.0, 0.0, share)")).alias("score"),
        F.max(F.expr("CASE WHEN template < 0 THEN rows END")).alias("copies"),
    )
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scanned_sql(templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> str:
    """The same over a DuckDB view ``documents``."""
    grams = ", ".join(f"({t}, {j}, '{g}', {x.gram})" for t, x in enumerate(templates) for j, g in enumerate(x.grams))
    listed = ", ".join(f"({i}, '{t.label}', {len(t.grams)}, {str(t.exact).lower()})" for i, t in enumerate(templates))
    return rf"""
WITH g(template, place, gram, k) AS (VALUES {grams}),
t(template, label, grams, exact) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(len(w))) AS pos FROM d),
n AS (SELECT r, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM p, (VALUES ({PHRASE_GRAM}), ({TEMPLATE_GRAM})) ks(k) WHERE pos + k <= len(w)),
v AS (SELECT r, template, pos - place AS diagonal, place FROM n JOIN g USING (gram, k)),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= CASE WHEN exact THEN 0 ELSE {NEIGHBOURS} END THEN 0 ELSE 1 END AS new
      FROM (SELECT DISTINCT r, template, diagonal FROM v) JOIN t USING (template) WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT r, template, diagonal, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM m),
f AS (SELECT r, template, min(diagonal) AS first, count(DISTINCT place) / grams::DOUBLE AS share, label, exact
      FROM s JOIN v USING (r, template, diagonal) JOIN t USING (template) GROUP BY r, template, span, grams, label, exact)
SELECT doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (exact AND share = 1) AS n_base,
       min(first) FILTER (exact AND share = 1) AS first_word, max(first) FILTER (exact AND share = 1) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (exact AND share = 1)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (share >= CASE WHEN exact THEN 1 ELSE {LEAST_SHARE} END)), ','), '') AS labels,
       coalesce(max(CASE WHEN exact AND share < 1 THEN 0 ELSE share END), 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id
"""
