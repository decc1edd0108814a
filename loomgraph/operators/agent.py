"""The round loop of retrieval as a loop over batches: every stage is one job over all open questions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vector import norm
from ..session import Scratch
from . import knn, traversal


def gap_status(attempts: DataFrame, gap: str, satisfied: Column, partial: Column, closed: Column | None = None, most: int = 2) -> DataFrame:
    """(gap, attempts, status): the state of each information gap from its history, best state first."""
    closed = F.lit(False) if closed is None else closed
    agg = attempts.groupBy(gap).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(satisfied).alias("s"), F.count_if(partial).alias("p"), F.count_if(closed).alias("c"))
    status = F.when(F.col("s") > 0, "satisfied").when(F.col("c") > 0, "manually_closed").when(F.col("p") > 0, "partially_satisfied").when(F.col("attempts") >= most, "exhausted").otherwise("active")
    return agg.select(gap, "attempts", status.alias("status"))


class Rounds(NamedTuple):
    """What the rounds leave: ``summary`` (question_id, rounds, n_docs, termination), ``documents`` (question_id,
    doc_id, at) and ``trace`` (question_id, round, path_rank, path, score, top_score, n_docs), a row for each path."""

    summary: DataFrame
    documents: DataFrame
    trace: DataFrame


def fallback_answers(documents: DataFrame, texts: DataFrame, most: int = 3, chars: int = 200) -> DataFrame:
    """(question_id, answer): titles and beginnings of the first documents of each question.

    ``documents`` are those of the rounds, ``texts`` has doc_id, title and text. Questions without documents are
    not in the result.
    """
    rn = F.row_number().over(Window.partitionBy("question_id").orderBy("at", "doc_id"))
    first = documents.withColumn("rn", rn).filter(F.col("rn") <= most).join(texts.select("doc_id", "title", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("begin")), "doc_id", "left")
    line = F.concat(F.coalesce("title", "doc_id"), F.lit(": "), F.coalesce("begin", F.lit("")), F.lit("..."))
    lines = first.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("l"))
    return lines.select("question_id", F.array_join("l.line", " ").alias("answer"))


def run_rounds(questions: DataFrame, adjacency: DataFrame, vectors: DataFrame, norm_value: float, rounds: int = Settings.max_rounds, enough: int = 5, most_docs: int = Settings.context_documents, names: DataFrame | None = None, entities: DataFrame | None = None, depth: int = Settings.beam_depth, k: int = Settings.anchor_k) -> DataFrame:
    """The summary of ``retrieve_rounds``: (question_id, rounds, n_docs, termination)."""
    return retrieve_rounds(questions, adjacency, vectors, norm_value, rounds, enough, most_docs, names, entities, depth, k).summary


def retrieve_rounds(questions: DataFrame, adjacency: DataFrame, vectors: DataFrame, norm_value: float, rounds: int = Settings.max_rounds, enough: int = 5, most_docs: int = Settings.context_documents, names: DataFrame | None = None, entities: DataFrame | None = None, depth: int = Settings.beam_depth, k: int = Settings.anchor_k) -> Rounds:
    """Plan, retrieve, map, update until enough is known.

    ``questions`` has question_id, vec and gap (the vector of its one gap), ``vectors`` node_id, doc_id, vec.
    ``names`` (question_id, pos, vec: the entity names of the gaps) are met in ``entities`` (node_id, vec: the
    entity nodes); propositions that mention these are anchors as well, behind the nearest ones.
    A question stops with ``no_valid_anchors``, ``information_sufficient`` (``enough`` documents) or
    ``max_rounds_reached``. Finished questions leave by anti-join; later rounds start from the leaves of the
    round before as well.
    """
    spark = questions.sparkSession
    scratch = Scratch(spark, "agent")
    vectors, adjacency = scratch.write(vectors, "vectors"), scratch.write(adjacency, "adjacency")
    open_q = scratch.write(questions, "open")
    docs = spark.createDataFrame([], "question_id long, doc_id string, at long")
    leaves = spark.createDataFrame([], "question_id long, node_id string")
    done = spark.createDataFrame([], "question_id long, rounds int, termination string")
    trace = spark.createDataFrame([], "question_id long, round int, path_rank int, path array<string>, score double, top_score double, n_docs long")
    named = scratch.write(traversal.named_entities(names, entities), "named") if names is not None and entities is not None else None
    items = vectors.filter(norm(F.col("vec")) > 0).select(F.col("node_id").alias("item_id"), "vec")
    for r in range(1, rounds + 1):
        asked = F.col("vec") if r == 1 else F.col("gap")
        near = knn.knn_join(open_q.select(F.col("question_id").alias("query_id"), asked.alias("vec")), items, k).select(F.col("query_id").alias("question_id"), F.col("item_id").alias("node_id"), F.col("item_rank").alias("pos"))
        if named is not None:
            by_name = traversal.entity_anchors(named.join(open_q, "question_id", "left_semi"), adjacency, vectors, open_q.select("question_id", asked.alias("vec")))
            near = traversal.ordered_union(near, by_name, "question_id", "node_id")
        anchors = near.select("question_id", "node_id")
        starts = scratch.write(anchors.unionByName(leaves.join(open_q, "question_id", "left_semi")).distinct(), "starts")
        none = open_q.join(starts, "question_id", "left_anti").select("question_id", F.lit(r).alias("rounds"), F.lit("no_valid_anchors").alias("termination"))
        tree = traversal.beam_search(starts, adjacency, vectors.select("node_id", "vec"), open_q.select("question_id", "vec"), norm_value, depth=depth)
        ranked = scratch.write(traversal.top_paths(traversal.leaf_paths(tree), 10), "ranked")
        nodes = ranked.select("question_id", "path_rank", F.posexplode("path").alias("pos", "node_id")).join(vectors.select("node_id", "doc_id"), "node_id")
        found = nodes.groupBy("question_id", "doc_id").agg(F.min((r * 1_000_000 + F.col("path_rank") * 1_000 + F.col("pos")).cast("long")).alias("at"))
        docs = scratch.write(traversal.keep_last(docs.unionByName(found), "question_id", "doc_id", F.col("at"), most_docs), "docs")
        count = docs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_docs"))
        top = ranked.groupBy("question_id").agg(F.max("normalized_score").alias("top_score"))
        walked = ranked.join(top, "question_id").join(count, "question_id", "left").select("question_id", F.lit(r).alias("round"), "path_rank", "path", F.col("normalized_score").alias("score"), "top_score", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
        trace = trace.unionByName(scratch.write(walked, "trace"))
        leaves = scratch.write(ranked.select("question_id", F.element_at("path", -1).alias("node_id")).distinct(), "leaves")
        known = docs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough)
        full = open_q.join(known, "question_id", "left_semi").select("question_id", F.lit(r).alias("rounds"), F.lit("information_sufficient").alias("termination"))
        done = scratch.write(done.unionByName(none).unionByName(full).dropDuplicates(["question_id"]), "done")
        open_q = scratch.write(open_q.join(done, "question_id", "left_anti"), "open")
        if not open_q.limit(1).count():
            break
    rest = open_q.select("question_id", F.lit(rounds).alias("rounds"), F.lit("max_rounds_reached").alias("termination"))
    count = docs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_docs"))
    summary = done.unionByName(rest).join(count, "question_id", "left").select("question_id", "rounds", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "termination")
    return Rounds(summary, docs, trace)
