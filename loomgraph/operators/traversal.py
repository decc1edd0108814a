"""Scoring, beam search over the graph, paths and document selection; all questions at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vector import cosine, norm
from ..session import Scratch
from .graph import MENTIONS
from .knn import knn_join


def semantic_score(question: Column, node: Column) -> Column:
    return F.round(F.coalesce(cosine(question, node), F.lit(0.0)), 6)


def bridge_score(new_entities: Column, norm: Column) -> Column:
    """min(1, ln(1 + new) / ln(1 + norm)); 0 where the norm is not positive."""
    return F.when(norm <= 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.log1p(new_entities) / F.log1p(norm)), 6))


def total_score(semantic: Column, bridge: Column, w_sem: float = 0.4, w_bridge: float = 0.3) -> Column:
    return F.round(w_sem * semantic + w_bridge * bridge, 6)


def anchor_priority(anchors: DataFrame, questions: DataFrame, gaps: DataFrame, w_question: float = 0.6, w_gap: float = 0.4) -> DataFrame:
    """(question_id, node_id, priority): similarity to the question and to the closest gap."""
    q = anchors.join(questions.select("question_id", F.col("vec").alias("qv")), "question_id")
    best = q.join(gaps.select("question_id", F.col("vec").alias("gv")), "question_id", "left").groupBy("question_id", "node_id").agg(F.max(semantic_score(F.col("qv"), F.col("vec"))).alias("s"), F.max(semantic_score(F.col("gv"), F.col("vec"))).alias("g"))
    return best.select("question_id", "node_id", F.round(w_question * F.col("s") + w_gap * F.coalesce("g", F.lit(0.0)), 6).alias("priority"))


def neighbours(frontier: DataFrame, adjacency: DataFrame, active: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Candidates (.., node_id -> to): active or similar edges between propositions, one hop over an entity, and
    from a frontier node that is an entity itself to the propositions that mention it. ``groups`` (question_id,
    group_id, edges) narrows the active edges of each group of the frontier to its own."""
    keys = [c for c in frontier.columns if c != "node_id"]
    direct = adjacency.filter(F.col("edge_type").isin([*active, "SIMILARITY"]) & (F.col("neighbour_type") == "proposition")).select("node_id", "edge_type", F.col("neighbour").alias("to"))
    to_entity = adjacency.filter((F.col("edge_type") == MENTIONS) & (F.col("neighbour_type") != "proposition")).select("node_id", F.col("neighbour").alias("entity"))
    from_entity = adjacency.filter((F.col("edge_type") == MENTIONS) & (F.col("neighbour_type") == "proposition")).select(F.col("node_id").alias("entity"), F.col("neighbour").alias("to"))
    one = frontier.join(direct, "node_id")
    if groups is not None:
        own = one.join(groups.select("question_id", "group_id", "edges"), ["question_id", "group_id"])
        one = own.filter((F.col("edge_type") == "SIMILARITY") | F.array_contains("edges", F.col("edge_type"))).drop("edges")
    one = one.drop("edge_type")
    two = frontier.join(to_entity, "node_id").join(from_entity, "entity").drop("entity")
    three = frontier.join(from_entity.withColumnRenamed("entity", "node_id"), "node_id")
    return one.unionByName(two).unionByName(three).filter("to <> node_id").select(*keys, "node_id", "to").distinct()


def new_entities(candidates: DataFrame, adjacency: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidates with the number of entities of ``to`` their question has not visited yet."""
    ents = adjacency.filter(F.col("edge_type") == MENTIONS).select(F.col("node_id").alias("to"), F.col("neighbour").alias("entity"))
    fresh = candidates.select("question_id", "to").distinct().join(ents, "to").join(visited, ["question_id", "entity"], "left_anti").groupBy("question_id", "to").agg(F.count_distinct("entity").alias("new"))
    return candidates.join(fresh, ["question_id", "to"], "left").withColumn("new", F.coalesce("new", F.lit(0)))


def beam_search(starts: DataFrame, adjacency: DataFrame, vectors: DataFrame, questions: DataFrame, norm: float, depth: int = Settings.beam_depth, width: int = Settings.beam_width, active: tuple[str, ...] = ("SKELETON", "DETAIL")) -> DataFrame:
    """Forests of all questions: rows (question_id, node_id, parent, depth, score, raw_score, path).

    Each depth scores the candidates of the frontier with the entities visited before it, keeps the best
    ``width`` edges of each question, and only then drops those that lead into the tree; the first edge to a
    node makes its parent. The window keeps ``width`` rows a question on each task before the exchange.
    """
    scratch = Scratch(starts.sparkSession, "beam")
    adjacency, questions = scratch.write(adjacency, "adjacency"), scratch.write(questions.select("question_id", "vec"), "questions")
    # read at every depth, so made once
    vectors = scratch.write(vectors.select("node_id", "vec"), "vectors")
    tree = scratch.write(starts.select("question_id", "node_id").distinct().select("question_id", "node_id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.lit(0.0).alias("raw_score"), F.array("node_id").alias("path")), "tree")
    frontier = tree
    ents = adjacency.filter(F.col("edge_type") == MENTIONS).select("node_id", F.col("neighbour").alias("entity"))
    visited = scratch.write(frontier.join(ents, "node_id").select("question_id", "entity").distinct(), "visited")
    for d in range(1, depth + 1):
        met = new_entities(neighbours(frontier.select("question_id", "raw_score", "path", "node_id"), adjacency, list(active)), adjacency, visited)
        scored = met.join(vectors.select(F.col("node_id").alias("to"), "vec"), "to").join(questions.select("question_id", F.col("vec").alias("q")), "question_id")
        scored = scored.withColumn("score", total_score(semantic_score(F.col("q"), F.col("vec")), bridge_score(F.col("new"), F.lit(float(norm))))).drop("vec", "q")
        order = [F.col("score").desc(), F.col("to"), F.col("node_id")]
        best = scored.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("r") <= width)
        fresh = best.join(tree.select("question_id", F.col("node_id").alias("to")), ["question_id", "to"], "left_anti")
        one = fresh.groupBy("question_id", "to").agg(F.min(F.struct("r", "node_id", "score", "raw_score", "path")).alias("b"))
        frontier = scratch.write(one.select("question_id", F.col("to").alias("node_id"), F.col("b.node_id").alias("parent"), F.lit(d).alias("depth"), F.col("b.score").alias("score"), F.round(F.col("b.raw_score") + F.col("b.score"), 6).alias("raw_score"), F.concat("b.path", F.array("to")).alias("path")), "frontier")
        if not frontier.limit(1).count():
            break
        tree = scratch.write(tree.unionByName(frontier), "tree")
        visited = scratch.write(visited.unionByName(frontier.join(ents, "node_id").select("question_id", "entity")).distinct(), "visited")
    return tree


def leaf_paths(tree: DataFrame) -> DataFrame:
    """(question_id, path, raw_score, normalized_score) of root-to-leaf paths."""
    leaves = tree.join(tree.filter("parent IS NOT NULL").select("question_id", F.col("parent").alias("node_id")), ["question_id", "node_id"], "left_anti")
    return leaves.select("question_id", "path", "raw_score", F.round(F.col("raw_score") / F.size("path"), 6).alias("normalized_score"))


def unique_paths(paths: DataFrame, order: list[Column]) -> DataFrame:
    """One row per exact node sequence of a question, the first in the order."""
    rn = F.row_number().over(Window.partitionBy("question_id", "path").orderBy(*order))
    return paths.withColumn("rn", rn).filter("rn = 1").drop("rn")


def top_paths(paths: DataFrame, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("normalized_score").desc(), F.array_join("path", " ")))
    return paths.withColumn("path_rank", rn).filter(F.col("path_rank") <= k)


def mmr(paths: DataFrame, most_in: int = 50, most_out: int = 10, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over the endpoints of at most 50 paths a question: (question_id, path_rank, mmr_rank)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path_rank", ignore_index=True)
        ends = [{p[0], p[-1]} for p in pdf["path"]]
        rel = pdf["normalized_score"].to_list()
        chosen: list[int] = []
        while len(chosen) < min(most_out, len(pdf)):
            def value(i: int) -> float:
                return weight * rel[i] - (1 - weight) * max((len(ends[i] & ends[j]) / len(ends[i] | ends[j]) for j in chosen), default=0.0)

            left = [i for i in range(len(pdf)) if i not in chosen]
            chosen.append(max(left, key=lambda i: (value(i) if chosen else rel[i], -i)))
        return pd.DataFrame({"question_id": pdf["question_id"].iloc[chosen].to_list(), "path_rank": pdf["path_rank"].iloc[chosen].astype("int32").to_list(), "mmr_rank": range(1, len(chosen) + 1)})

    return top_paths(paths, most_in).groupBy("question_id").applyInPandas(choose, "question_id long, path_rank int, mmr_rank int")


def documents_of_paths(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """(question_id, doc_id, doc_rank): documents in the order their first node appears in the ranked paths.

    ``ranked`` has question_id, path_rank and docs, the documents of the path's nodes in order.
    """
    first = ranked.select("question_id", "path_rank", F.posexplode("docs").alias("pos", "doc_id")).filter("doc_id IS NOT NULL").groupBy("question_id", "doc_id").agg(F.min(F.struct("path_rank", "pos")).alias("f"))
    rn = F.row_number().over(Window.partitionBy("question_id").orderBy("f.path_rank", "f.pos", "doc_id"))
    return first.withColumn("doc_rank", rn).filter(F.col("doc_rank") <= limit).select("question_id", "doc_id", F.col("doc_rank").cast("int").alias("doc_rank"))


def ordered_union(first: DataFrame, second: DataFrame, key: str, item: str) -> DataFrame:
    """Rows of the first list, then those of the second that the first lacks: (key, item, source, pos)."""
    both = first.select(key, item, F.lit(0).alias("source"), "pos").unionByName(second.select(key, item, F.lit(1).alias("source"), "pos"))
    return both.groupBy(key, item).agg(F.min(F.struct("source", "pos")).alias("f")).select(key, item, "f.source", "f.pos")


def named_entities(names: DataFrame, entities: DataFrame, threshold: float = 0.7, most: int = 5) -> DataFrame:
    """(question_id, pos, node_id): the entity node most similar to each name, of the first ``most`` names that have one.

    ``names`` has question_id, pos and vec (of the name), ``entities`` node_id and vec.
    """
    asked = names.select(F.struct("question_id", "pos").alias("query_id"), "vec").filter(norm(F.col("vec")) > 0)
    items = entities.filter(norm(F.col("vec")) > 0).select(F.col("node_id").alias("item_id"), "vec")
    hit = knn_join(asked, items, 1, threshold).select("query_id.question_id", "query_id.pos", F.col("item_id").alias("node_id"))
    rn = F.row_number().over(Window.partitionBy("question_id").orderBy("pos"))
    return hit.withColumn("rn", rn).filter(F.col("rn") <= most).drop("rn")


def entity_anchors(named: DataFrame, adjacency: DataFrame, vectors: DataFrame, questions: DataFrame, per_entity: int = 3, most_props: int = 50) -> DataFrame:
    """(question_id, node_id, similarity, pos): propositions that mention the named entities, most similar first.

    At most ``most_props`` propositions of an entity count, in order of their ids, and ``per_entity`` times the
    named entities of a question come out. ``questions`` has question_id and vec.
    """
    of_entity = named.select("node_id").distinct().join(adjacency.filter((F.col("edge_type") == MENTIONS) & (F.col("neighbour_type") == "proposition")).select("node_id", F.col("neighbour").alias("prop")).distinct(), "node_id")
    first = of_entity.withColumn("rn", F.row_number().over(Window.partitionBy("node_id").orderBy("prop"))).filter(F.col("rn") <= most_props).drop("rn")
    met = named.select("question_id", "node_id").distinct().join(first, "node_id").select("question_id", F.col("prop").alias("node_id")).distinct()
    scored = met.join(vectors.select("node_id", "vec"), "node_id").join(questions.select("question_id", F.col("vec").alias("q")), "question_id").groupBy("question_id", "node_id").agg(F.max(semantic_score(F.col("q"), F.col("vec"))).alias("similarity"))
    limit = named.groupBy("question_id").agg((F.count(F.lit(1)) * per_entity).alias("most"))
    rn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("similarity").desc(), "node_id"))
    return scored.withColumn("pos", rn).join(limit, "question_id").filter(F.col("pos") <= F.col("most")).drop("most")


def refill_from_entities(entities: DataFrame, adjacency: DataFrame, visited: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, node_id, priority): of each entity of a question the first k propositions, without the visited
    ones; the priority is the degree. ``entities`` and ``visited`` have question_id and node_id."""
    props = entities.select("node_id").distinct().join(adjacency.filter(F.col("neighbour_type") == "proposition").select("node_id", F.col("neighbour").alias("prop")).distinct(), "node_id")
    first = props.withColumn("rn", F.row_number().over(Window.partitionBy("node_id").orderBy("prop"))).filter(F.col("rn") <= k)
    new = entities.join(first, "node_id").select("question_id", F.col("prop").alias("node_id")).distinct().join(visited, ["question_id", "node_id"], "left_anti")
    edges = adjacency.select("node_id", "neighbour").distinct()
    ends = edges.select("node_id").unionByName(edges.select(F.col("neighbour").alias("node_id")))
    degree = ends.join(new.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).cast("double").alias("priority"))
    return new.join(degree, "node_id").select("question_id", "node_id", "priority")


def exclusive(assignments: DataFrame, item: str, owner: str) -> DataFrame:
    """Every item goes to the first owner that has it."""
    return assignments.groupBy(item).agg(F.min(owner).alias(owner))


def keep_last(documents: DataFrame, key: str, item: str, order: Column, most: int) -> DataFrame:
    """The last ``most`` distinct items of each key, by when they came first."""
    came = documents.groupBy(key, item).agg(F.min(order).alias("at"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").desc(), F.col(item).desc()))
    return came.withColumn("rn", rn).filter(F.col("rn") <= most).drop("rn")


def plateau(scores: DataFrame, key: str, order: str, score: str, window: int, threshold: float) -> DataFrame:
    """Rows where the last ``window`` scores lie closer together than the threshold."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    spread = F.max(score).over(w) - F.min(score).over(w)
    return scores.withColumn("stop", (F.count(F.lit(1)).over(w) == window) & (spread < threshold))
