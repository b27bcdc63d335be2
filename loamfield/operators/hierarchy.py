"""Trees of themes and codes, and the algebra of clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Leaves of a codebook that a clustering takes, at most.
MOST_LEAVES = 100_000


def paths(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", name: str = "name", most_depth: int = 50) -> DataFrame:
    """(node, root, depth, path ARRAY, names ARRAY) of every node below the roots, level by level.

    A level is a join on the parent; a cycle, or a tree deeper than ``most_depth``, is an
    error, and nodes that no root reaches are left out.
    """
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    level = base.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(1).alias("depth"), F.array("node").alias("path"), F.array("name").alias("names"))
    out = level
    for _ in range(most_depth):
        below = base.alias("b").join(level.alias("l"), F.col("b.parent") == F.col("l.node"))
        level = below.select(F.col("b.node").alias("node"), "l.root", (F.col("l.depth") + 1).alias("depth"), F.concat("l.path", F.array("b.node")).alias("path"), F.concat("l.names", F.array("b.name")).alias("names"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree is deeper than {most_depth}, or has a cycle")


def rolled_up(refs: DataFrame, tree: DataFrame, source: str = "source") -> DataFrame:
    """(node, n_refs, n_sources): references (node, source) of a node and all below it, sources once."""
    each = refs.join(tree.select("node", "path"), "node").select(F.explode("path").alias("node"), source)
    return each.groupBy("node").agg(F.count("*").alias("n_refs"), F.countDistinct(source).alias("n_sources"))


def node_counts(tree: DataFrame, codes: DataFrame) -> DataFrame:
    """(root, n_subthemes, n_subthemes_total, n_codes) of trees: named nodes at the first level below, at all levels, and distinct codes (node, code_key)."""
    named = F.element_at("names", -1).isNotNull()
    below = tree.groupBy("root").agg(F.count_if((F.col("depth") == 2) & named).alias("n_subthemes"), F.count_if((F.col("depth") >= 2) & named).alias("n_subthemes_total"))
    held = tree.join(codes, "node").groupBy("root").agg(F.countDistinct("code_key").alias("n_codes"))
    return below.join(held, "root", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0)).cast("long"))


def code_to_theme(tree: DataFrame, node_codes: DataFrame) -> DataFrame:
    """(code_key, theme, subtheme): a code's top node and the node below it; of several the last by path counts."""
    rows = node_codes.join(tree, "node").select("code_key", F.element_at("names", 1).alias("theme"), F.get("names", F.lit(1)).alias("subtheme"), "path")
    best = rows.groupBy("code_key").agg(F.max(F.struct(F.transform("path", lambda x: x.cast("string")).alias("path"), "theme", "subtheme")).alias("b"))
    return best.select("code_key", "b.theme", "b.subtheme")


def theme_table(membership: DataFrame, codes: DataFrame) -> DataFrame:
    """(theme, n_entries, codes): one row a theme with its codes joined by ``"; "``."""
    n = membership.groupBy("theme").agg(F.countDistinct("std_id").alias("n_entries"))
    return codes.groupBy("theme").agg(F.array_join(F.array_sort(F.collect_set("code_key")), "; ").alias("codes")).join(n, "theme", "left").select("theme", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "codes")


def unique_names(themes: DataFrame, name: str = "name", order: str = "theme_id") -> DataFrame:
    """Repeated names told apart: the second of a name becomes ``name (2)``, and so on."""
    i = F.row_number().over(W.partitionBy(F.lower(F.col(name))).orderBy(order))
    return themes.withColumn("_i", i).withColumn(name, F.when(F.col("_i") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("_i").cast("string"), F.lit(")")))).drop("_i")


def legacy_codes(cell: Column) -> Column:
    """Codes of a list stored as ``;``-joined text, in order, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


# --- clusterings ----------------------------------------------------------------------------


def normalised_partition(proposal: DataFrame, leaves: DataFrame) -> DataFrame:
    """(cluster, leaf) over all leaves from a proposal (cluster, leaf).

    Leaves out of range are dropped, a leaf in several clusters stays in the first, leaves in
    none become clusters of their own, numbered on from the last.
    """
    valid = proposal.join(leaves.select("leaf"), "leaf", "left_semi").groupBy("leaf").agg(F.min("cluster").alias("cluster"))
    last = valid.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("_last"))
    left = leaves.select("leaf").join(valid, "leaf", "left_anti").withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("leaf")))  # leaves of a codebook
    singles = left.crossJoin(F.broadcast(last)).select((F.col("_last") + F.col("_i")).alias("cluster"), "leaf")
    return valid.select("cluster", "leaf").unionByName(singles)


def applied_partition(leaves: DataFrame, partition: DataFrame) -> DataFrame:
    """(cluster, leaves, codes): merged leaves (leaf, codes ARRAY) with the union of their codes and their lineage."""
    joined = leaves.join(partition, "leaf")
    return joined.groupBy("cluster").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def is_identity(partition: DataFrame) -> DataFrame:
    """One row: whether every cluster has one leaf."""
    return partition.groupBy("cluster").agg(F.count("*").alias("k")).agg((F.max("k") == 1).alias("identity"))


def canonical(partition: DataFrame) -> DataFrame:
    """One row: a text that is equal for equal sets of sets of leaves."""
    sets = partition.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set(F.col("leaf").cast("string"))), ",").alias("s"))
    return sets.agg(F.array_join(F.array_sort(F.collect_set("s")), "|").alias("canonical"))


def themes_and_subthemes(passes: DataFrame) -> DataFrame:
    """(theme, subtheme, code_key) from (pass, cluster, code_key): the last pass gives themes, the one before subthemes.

    With one pass themes have no subthemes.
    """
    last = passes.agg(F.max("pass").alias("_last"))
    rows = passes.crossJoin(F.broadcast(last))  # one row
    top = rows.where("pass = _last").select("code_key", F.col("cluster").alias("theme"))
    sub = rows.where("pass = _last - 1").select("code_key", F.col("cluster").alias("subtheme"))
    return top.join(sub, "code_key", "left").select("theme", "subtheme", "code_key")


def multipass(leaves: DataFrame, propose, most_passes: int = 20) -> tuple[DataFrame, int]:
    """Leaves merged pass by pass until a proposal is the identity, repeats, or none is made.

    ``propose(leaves, n)`` gives (cluster, leaf) or None.  Leaves are a codebook's, at most
    MOST_LEAVES; each pass is a few small jobs, after which its rows are held as they are.
    """
    seen: set[str] = set()
    for n in range(1, most_passes + 1):
        proposal = propose(leaves, n)
        if proposal is None:
            return leaves, n - 1
        partition = normalised_partition(proposal, leaves)
        text = canonical(partition).first()["canonical"]
        if is_identity(partition).first()["identity"] or text in seen:
            return leaves, n - 1
        seen.add(text)
        merged = applied_partition(leaves, partition).select(F.col("cluster").alias("leaf"), "codes")
        rows = merged.limit(MOST_LEAVES + 1).collect()
        if len(rows) > MOST_LEAVES:
            raise ValueError(f"a codebook has at most {MOST_LEAVES} leaves")
        leaves = leaves.sparkSession.createDataFrame(rows, merged.schema)
    return leaves, most_passes


def framework_themes(codes: DataFrame, constructs: DataFrame, anomalies: DataFrame, policy: str = "bracket") -> DataFrame:
    """(theme, kind, frequency): constructs that were coded, and anomalies by policy.

    ``bracket`` makes one theme of all anomalies, ``extend`` one for each of their names,
    ``revise`` as extend with the kind revised.
    """
    if policy not in ("bracket", "extend", "revise"):
        raise ValueError("policy is bracket, extend or revise")
    base = constructs.select(F.col("id").alias("code_key"), F.col("name").alias("theme")).join(codes, "code_key").groupBy("theme").agg(F.sum("frequency").alias("frequency")).where("frequency > 0")
    base = base.select("theme", F.lit("framework").alias("kind"), "frequency")
    if policy == "bracket":
        more = anomalies.agg(F.count("*").alias("frequency")).where("frequency > 0").select(F.lit("Anomalies").alias("theme"), F.lit("anomaly_bracket").alias("kind"), "frequency")
    else:
        kind = "emergent" if policy == "extend" else "revised"
        more = anomalies.groupBy(F.col("slug").alias("theme")).agg(F.count("*").alias("frequency")).select("theme", F.lit(kind).alias("kind"), "frequency")
    return base.unionByName(more)


def segment_key(doc: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", doc, start, end)


def chunked(codes: DataFrame, order: str, size: int = 50) -> DataFrame:
    """``codes`` of a codebook with a chunk number of ``size`` each in order."""
    return codes.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1) / size))


def indent_parents(book: DataFrame, book_id: str, order: str, level: str, name: str, most_levels: int = 20) -> DataFrame:
    """``book`` with the parent of each line by its indent level: the last line above it of the level before."""
    lines = W.partitionBy(book_id).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for k in range(most_levels, 0, -1):
        parent = F.when(F.col(level) == k, F.last(F.when(F.col(level) == k - 1, F.col(name)), ignorenulls=True).over(lines)).otherwise(parent)
    return book.withColumn("parent", parent)


def path_levels(path: Column, delimiters: Sequence[str] = ("\\\\", "::", " > ")) -> Column:
    """Parts of a hierarchical name at the first delimiter that it has."""
    out = F.array(F.trim(path))
    for d in reversed(delimiters):
        out = F.when(path.contains(d.replace("\\\\", "\\")), F.transform(F.split(path, d), lambda x: F.trim(x))).otherwise(out)
    return out
