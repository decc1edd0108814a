"""Sets of paths: membership, prefixes, statistics, similarity; and bounded queues of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import traversal
from .graph import MENTIONS


def contained(probes: DataFrame, paths: DataFrame) -> DataFrame:
    """Probes (question_id, path, ..) that are among the paths of their question."""
    return probes.join(paths.select("question_id", "path").distinct(), ["question_id", "path"], "left_semi")


def removed(paths: DataFrame, gone: DataFrame) -> DataFrame:
    """Paths without those that are taken out."""
    return paths.join(gone.select("question_id", "path"), ["question_id", "path"], "left_anti")


def with_prefixes(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Paths of the question of a prefix (question_id, prefix) that begin with it. Prefixes meet paths by their first
    node and question, so no pair is looked at that cannot match."""
    p = prefixes.select("question_id", "prefix", F.try_element_at("prefix", F.lit(1)).alias("head"))
    met = paths.withColumn("head", F.try_element_at("path", F.lit(1))).join(p, ["question_id", "head"])
    return met.filter(F.slice("path", 1, F.size("prefix")) == F.col("prefix")).drop("head")


def prefix_counts(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(question_id, prefix, n): distinct paths below each prefix, 0 included."""
    n = with_prefixes(paths.select("question_id", "path").distinct(), prefixes).groupBy("question_id", "prefix").agg(F.count(F.lit(1)).alias("n"))
    return prefixes.select("question_id", "prefix").distinct().join(n, ["question_id", "prefix"], "left").select("question_id", "prefix", F.coalesce("n", F.lit(0)).alias("n"))


def trie_statistics(paths: DataFrame) -> DataFrame:
    """(question_id, nodes, unique_paths, attempts): distinct prefixes with the empty one, distinct paths, all rows."""
    each = paths.groupBy("question_id", "path").agg(F.count(F.lit(1)).alias("times"))
    heads = each.filter(F.size("path") > 0).select("question_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice(F.col("path"), F.lit(1), i))).alias("prefix"))
    nodes = heads.distinct().groupBy("question_id").agg((F.count(F.lit(1)) + 1).alias("nodes"))
    return each.groupBy("question_id").agg(F.count(F.lit(1)).alias("unique_paths"), F.sum("times").alias("attempts")).join(nodes, "question_id", "left").select("question_id", F.coalesce("nodes", F.lit(1)).alias("nodes"), "unique_paths", "attempts")


def last_of_kind(paths: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """Paths with ``last``, their last node of a kind (null if none). ``kinds`` has node_id and node_type."""
    keys = [c for c in paths.columns if c != "path"]
    each = paths.select(*keys, F.posexplode("path").alias("pos", "node_id")).join(kinds.filter(F.col("node_type") == kind).select("node_id").distinct(), "node_id", "left_semi")
    last = each.groupBy(*keys).agg(F.max_by("node_id", "pos").alias("last"))
    return paths.join(last, keys, "left")


def uncovered(paths: DataFrame) -> DataFrame:
    """Paths some node of which is in no longer path of the question (of equal length: in none before it)."""
    ordered = F.struct((-F.size("path")).alias("short"), F.array_join("path", " ").alias("name"))
    each = paths.select("question_id", "path").distinct().select("question_id", "path", ordered.alias("o"))
    first = each.select("question_id", "o", F.explode(F.array_distinct("path")).alias("node_id")).groupBy("question_id", "node_id").agg(F.min("o").alias("o"))
    return each.join(first.select("question_id", "o").distinct(), ["question_id", "o"], "left_semi").select("question_id", "path")


def pruned(paths: DataFrame, width: int, group: str | None = None) -> DataFrame:
    """The ``width`` best of each question by accumulated score, over all its groups or in each."""
    by = ["question_id"] if group is None else ["question_id", group]
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("raw_score").desc(), F.array_join("path", " ")))
    return paths.withColumn("rn", rn).filter(F.col("rn") <= width).drop("rn")


def path_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two paths over all their nodes; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def bounded_queue(anchors: DataFrame, most: int, visited: DataFrame | None = None) -> DataFrame:
    """(question_id, node_id, priority, place): anchors once each with their first priority, without visited ones,
    the ``most`` best of each question. ``anchors`` has question_id, node_id, priority and came."""
    new = anchors if visited is None else anchors.join(visited, ["question_id", "node_id"], "left_anti")
    once = new.groupBy("question_id", "node_id").agg(F.min_by("priority", "came").alias("priority"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("priority").desc(), "node_id"))
    return once.withColumn("place", place).filter(F.col("place") <= most)


def first_in_order(lists: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """(key, item, place): items of several lists of a key in order, each once where it comes first."""
    first = lists.groupBy(key, item).agg(F.min(F.struct(*order)).alias("o"))
    return first.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy("o", item)).alias("place"))


def grouped_beam(starts: DataFrame, groups: DataFrame, adjacency: DataFrame, vectors: DataFrame, questions: DataFrame, norm: float, depth: int, width: int, plateau: float = 0.05, patience: int = 2) -> DataFrame:
    """Beam search over several groups of a question at once: rows (question_id, group_id, path, raw_score, depth).

    ``starts`` has question_id, group_id and node_id, ``groups`` question_id, group_id and edges (the edge types the
    group may use). All paths of a question, whatever their group, compete for the ``width`` places of a depth; a
    node may come again in another path but not in the same one. A question stops when no path can be extended, when
    no path of two or more steps met a new entity in its last one, or when from the third depth on its best score gained less than
    ``plateau`` in ``patience`` depths. New entities are counted against those of the path itself.
    """
    scratch = Scratch(starts.sparkSession, "grouped")
    adjacency = scratch.write(adjacency, "adjacency")
    ents = adjacency.filter(F.col("edge_type") == MENTIONS).groupBy("node_id").agg(F.array_sort(F.collect_set("neighbour")).alias("ents"))
    ents = scratch.write(ents, "ents")
    none = F.array().cast("array<string>")
    first = starts.select("question_id", "group_id", "node_id").distinct().join(ents, "node_id", "left")
    now = scratch.write(first.select("question_id", "group_id", F.array("node_id").alias("path"), F.lit(0.0).alias("raw_score"), F.coalesce("ents", none).alias("seen"), F.lit(0.0).alias("bridge"), F.lit(0).alias("depth"), F.lit(0.0).alias("best"), F.lit(0).alias("flat")), "paths")
    kept = [now]
    for d in range(1, depth + 1):
        alive = now.groupBy("question_id").agg(F.max("bridge").alias("b"), F.max("flat").alias("f"))
        goes = alive.filter((F.lit(d) <= 2) | (F.col("b") > 0)).filter(F.col("f") < patience).select("question_id")
        front = now.join(goes, "question_id", "left_semi").withColumn("node_id", F.element_at("path", -1))
        cand = traversal.neighbours(front.select("question_id", "group_id", "path", "raw_score", "seen", "best", "flat", "node_id"), adjacency, ["SKELETON", "DETAIL"], groups)
        cand = cand.filter(~F.array_contains("path", F.col("to"))).join(ents.select(F.col("node_id").alias("to"), "ents"), "to", "left")
        fresh = F.size(F.array_except(F.coalesce("ents", none), F.col("seen")))
        scored = cand.join(vectors.select(F.col("node_id").alias("to"), "vec"), "to").join(questions.select("question_id", F.col("vec").alias("q")), "question_id")
        bridge = traversal.bridge_score(fresh, F.lit(float(norm)))
        scored = scored.select("question_id", "group_id", F.concat("path", F.array("to")).alias("path"), F.round(F.col("raw_score") + traversal.total_score(traversal.semantic_score(F.col("q"), F.col("vec")), bridge), 6).alias("raw_score"), F.array_union("seen", F.coalesce("ents", none)).alias("seen"), bridge.alias("bridge"), F.lit(d).alias("depth"), "best", "flat")
        top = pruned(scored, width)
        gain = F.max("raw_score").over(Window.partitionBy("question_id")) - F.col("best")
        flat = F.when(F.lit(d) < 3, F.lit(0)).when(gain < plateau, F.col("flat") + 1).otherwise(F.lit(0))
        now = scratch.write(top.withColumn("flat", flat).withColumn("best", F.max("raw_score").over(Window.partitionBy("question_id"))), "paths")
        if not now.limit(1).count():
            break
        kept.append(now)
    deepest = kept[0].select("question_id", "group_id", "path", "raw_score", "depth")
    for rows in kept[1:]:  # a question's result is its last depth
        rows = rows.select("question_id", "group_id", "path", "raw_score", "depth")
        deepest = deepest.join(rows.select("question_id").distinct(), "question_id", "left_anti").select(*rows.columns).unionByName(rows)
    return deepest
