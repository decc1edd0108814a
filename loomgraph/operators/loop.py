"""The whole question-answering loop over a batch of questions: plan, rewrite, retrieve, validate, map, evaluate, answer.

Every step is one job over all open questions; model calls go through ``models.complete``, an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import numbered_lines
from ..models import EmbeddingModel, TextModel, complete, embed_distinct
from ..session import Scratch
from . import agent, knn, paths, stages, traversal

#: Gaps of a question and round that are told apart.
GAPS = 100


class Knowledge(NamedTuple):
    """What is searched: ``nodes`` (node_id, doc_id, text, vec) of propositions, ``entities`` (node_id, vec),
    ``adjacency`` rows, ``documents`` (doc_id, title, text), and the ``norm`` of the global statistics."""

    nodes: DataFrame
    entities: DataFrame
    adjacency: DataFrame
    documents: DataFrame
    norm: float


class Outcome(NamedTuple):
    """``answers`` (question_id, answer, short_answer, confidence), ``summary`` (question_id, rounds, termination), ``gaps``
    (question_id, gap_id, status, attempts), ``documents`` (question_id, doc_id, at) and ``trace`` (question_id, round, gap_id, path)."""

    answers: DataFrame
    summary: DataFrame
    gaps: DataFrame
    documents: DataFrame
    trace: DataFrame


def _prompt(task: str, *parts: Column) -> Column:
    """A prompt: the task by name, then its parts under each other."""
    return F.concat_ws("\n\n", F.lit(f"TASK: {task}. Reply with JSON."), *parts)


def _listed(rows: DataFrame, order: list[str], text: Column) -> DataFrame:
    """(question_id, listed): texts of a question in order as numbered lines. They are as many as a prompt holds."""
    each = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("text")))).alias("l"))
    return each.select("question_id", numbered_lines(F.transform("l", lambda x: x["text"])).alias("listed"))


def answer_questions(questions: DataFrame, known: Knowledge, text_model: Callable[[], TextModel], embedding_model: Callable[[], EmbeddingModel], settings: Settings | None = None, most_paths: int = 10) -> Outcome:
    """Answers of questions (question_id, question).

    A round asks whether the documents found so far are enough and else which gaps are open, rewrites a query for each
    gap, searches propositions by vector and by the entities a gap names, keeps the anchors the model accepts (each for
    the first gap that found it), grows a tree for each gap from them and from the leaves of the round before, takes the documents of
    the best paths, and has the gaps judged, which decides what documents stay. A question leaves with
    ``information_sufficient`` or ``no_valid_anchors``, the rest with ``max_rounds_reached``; then all are answered. Where a call fails, the
    stage says what holds instead (see ``stages``).
    """
    s = settings or Settings()
    spark = questions.sparkSession
    scratch = Scratch(spark, "loop")
    nodes, adjacency = scratch.write(known.nodes, "nodes"), scratch.write(known.adjacency, "adjacency")
    vectors = nodes.select("node_id", "doc_id", "vec")
    open_ = scratch.write(questions.select("question_id", "question"), "open")
    empty = lambda schema: spark.createDataFrame([], schema)
    docs, leaves = empty("question_id long, doc_id string, at long"), empty("question_id long, node_id string")
    history, states = empty("question_id long, gap_id string, description string, status string, attempts int"), empty("question_id long, gap_id string, status string, attempts int")
    done, trace = empty("question_id long, rounds int, termination string"), empty("question_id long, round int, gap_id string, path array<string>")
    titled = known.documents.select("doc_id", "title", "text")

    def with_documents(rows: DataFrame) -> DataFrame:
        """Rows with the documents found so far, as a prompt tells them."""
        found = docs.join(titled, "doc_id", "left").select("question_id", "at", "doc_id", F.concat(F.coalesce("title", "doc_id"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("t"))
        return rows.join(_listed(found, ["at", "doc_id"], F.col("t")), "question_id", "left").withColumn("listed", F.coalesce("listed", F.lit("no documents")))

    for r in range(1, s.max_rounds + 1):
        count = docs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_docs"))
        asked = with_documents(open_).join(count, "question_id", "left").select("question_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), _prompt("plan", F.col("question"), F.col("listed")).alias("prompt"))
        answerable, gaps = stages.planned(scratch.write(complete(asked, "prompt", text_model), "plan"), history)
        enough = scratch.write(answerable.filter("can_answer").select("question_id", F.lit(r).alias("rounds"), F.lit("information_sufficient").alias("termination")), "enough")
        done = done.unionByName(enough)
        open_ = scratch.write(open_.join(enough, "question_id", "left_anti"), "open")
        if not open_.limit(1).count():
            break
        # a question without a gap is its own gap
        bare = open_.join(gaps, "question_id", "left_anti").select("question_id", F.lit(0).alias("place"), F.lit("question").alias("gap_id"), F.col("question").alias("description"), F.lit("Bridge_Entity").alias("label"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("edges"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
        gaps = gaps.join(open_, "question_id", "left_semi").filter(F.col("place") < GAPS)
        gaps = scratch.write(gaps.withColumn("attempts", F.col("attempts").cast("int")).unionByName(bare), "gaps")
        listed = _listed(gaps, ["place"], F.col("description"))
        rewritten = stages.rewritten(gaps, complete(listed.select("question_id", _prompt("rewrite", F.col("listed")).alias("prompt")), "prompt", text_model))
        gap_key = (F.col("question_id") * GAPS + F.col("place")).alias("gap")
        queries = rewritten.join(embed_distinct(rewritten, "query", embedding_model), "query")
        queries = scratch.write(queries.select("question_id", "place", gap_key, "vec"), "queries")

        items = nodes.select(F.col("node_id").alias("item_id"), "vec")
        near = knn.knn_join(queries.select(F.col("gap").alias("query_id"), "vec"), items, s.anchor_k).select(F.col("query_id").alias("question_id"), F.col("item_id").alias("node_id"), F.col("item_rank").alias("pos"))
        names = gaps.select(gap_key, F.posexplode("entities").alias("pos", "name")).filter("trim(coalesce(name, '')) <> ''")
        names = names.join(embed_distinct(names, "name", embedding_model), "name").select(F.col("gap").alias("question_id"), "pos", "vec")
        named = traversal.named_entities(names, known.entities)
        by_name = traversal.entity_anchors(named, adjacency, vectors, queries.select(F.col("gap").alias("question_id"), "vec"))
        both = scratch.write(traversal.ordered_union(near, by_name, "question_id", "node_id"), "both")
        split = lambda df: df.withColumn("gap", F.col("question_id")).withColumn("question_id", F.expr(f"gap div {GAPS}"))
        # an anchor belongs to the first gap of its question that found it
        first = split(both).groupBy("question_id", "node_id").agg(F.min(F.struct("gap", "source", "pos")).alias("o")).select("question_id", "node_id", "o.gap", F.col("o.source").alias("source"), F.col("o.pos").alias("came"))
        ordered = paths.first_in_order(first, "question_id", "node_id", ["gap", "source", "came"]).select("question_id", "node_id", F.col("place").alias("pos"))
        batches = scratch.write(stages.anchor_batches(ordered.join(first.select("question_id", "node_id", "gap"), ["question_id", "node_id"])), "batches")
        told = batches.join(nodes.select("node_id", "text"), "node_id").join(open_, "question_id")
        lines = told.groupBy("question_id", "batch").agg(F.first("question").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("node_id", F.lit(": "), F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
        replies = complete(lines.select("question_id", "batch", _prompt("validate", F.col("question"), F.col("lines")).alias("prompt")), "prompt", text_model)
        anchors = scratch.write(stages.validated(batches, replies).join(batches.select("question_id", "node_id", "gap"), ["question_id", "node_id"]), "anchors")
        none = scratch.write(open_.join(anchors, "question_id", "left_anti").select("question_id", F.lit(r).alias("rounds"), F.lit("no_valid_anchors").alias("termination")), "none")
        done = done.unionByName(none)
        open_ = scratch.write(open_.join(none, "question_id", "left_anti"), "open")

        live = queries.join(open_, "question_id", "left_semi")
        old = leaves.join(live.select("question_id", "gap"), "question_id").select("gap", "node_id")
        starts = anchors.select("gap", "node_id").unionByName(old).distinct().join(live.select("gap"), "gap", "left_semi")
        tree = traversal.beam_search(starts.withColumnRenamed("gap", "question_id"), adjacency, vectors.select("node_id", "vec"), live.select(F.col("gap").alias("question_id"), "vec"), known.norm, depth=s.beam_depth, width=s.beam_width)
        found = split(traversal.leaf_paths(tree))
        ranked = scratch.write(traversal.top_paths(found, most_paths), "ranked")
        leaves = scratch.write(ranked.select("question_id", F.element_at("path", -1).alias("node_id")).distinct(), "leaves")
        in_docs = F.transform("path", lambda x: x)
        each = ranked.select("question_id", "path_rank", F.posexplode(in_docs).alias("pos", "node_id")).join(vectors.select("node_id", "doc_id"), "node_id")
        of_path = each.groupBy("question_id", "path_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
        got = scratch.write(traversal.documents_of_paths(of_path, s.top_documents).select("question_id", "doc_id", F.col("doc_rank").cast("long").alias("pos")), "got")
        trace = trace.unionByName(scratch.write(ranked.join(gaps.select("gap_id", gap_key), "gap").select("question_id", F.lit(r).alias("round"), "gap_id", "path"), "trace"))

        sight = got.join(titled, "doc_id", "left").select("question_id", "pos", F.concat("doc_id", F.lit(" | "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("t"))
        judged = _listed(gaps.join(open_, "question_id", "left_semi"), ["place"], F.concat("gap_id", F.lit(" | "), "description")).withColumnRenamed("listed", "open_gaps").join(_listed(sight, ["pos"], F.col("t")), "question_id", "left")
        verdicts = complete(judged.select("question_id", _prompt("evaluate", F.col("open_gaps"), F.coalesce("listed", F.lit("no documents"))).alias("prompt")), "prompt", text_model)
        new, added, _ = stages.evaluated(gaps.join(open_, "question_id", "left_semi").select("question_id", "gap_id", "attempts"), scratch.write(verdicts, "verdicts"), got, s.max_attempts)
        new = scratch.write(new.select("question_id", "gap_id", "status", F.col("attempts").cast("int").alias("attempts")), "states")
        states = scratch.write(stages.upsert_states(states, new), "states")
        described = new.join(gaps.select("question_id", "gap_id", "description"), ["question_id", "gap_id"]).select(*history.columns)
        history = scratch.write(stages.upsert_states(history, described), "history")
        kept = docs.unionByName(added.select("question_id", "doc_id", (F.lit(r * 1_000) + F.col("place")).cast("long").alias("at")))
        docs = scratch.write(traversal.keep_last(kept, "question_id", "doc_id", F.col("at"), s.context_documents), "docs")
        if not open_.limit(1).count():
            break
    done = done.unionByName(open_.join(done, "question_id", "left_anti").select("question_id", F.lit(s.max_rounds).alias("rounds"), F.lit("max_rounds_reached").alias("termination")))
    asked = with_documents(questions.select("question_id", "question")).select("question_id", _prompt("answer", F.col("question"), F.col("listed")).alias("prompt"))
    answers = stages.answered(complete(asked, "prompt", text_model), agent.fallback_answers(docs, titled))
    return Outcome(scratch.write(answers, "answers"), scratch.write(done, "done"), states, docs, trace)
