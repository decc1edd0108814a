"""The stages of the retrieval loop that a model takes part in, each one step over all questions of a batch.

Every stage takes the replies of ``models.complete`` as a table with question_id and reply, null where the call
failed, and says what happens then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import fallback_answer, json_text, reply_answer
from ..functions.text import clean_short_answer, jaccard, words_lower

_PLAN = "can_answer boolean, info_gaps array<struct<gap_id:string,gap_description:string,intent_label:string,related_entities:array<string>,active_edges:array<string>>>"
_EVALUATION = "intent_evaluation array<struct<gap_id:string,status:string,next_hint:string>>, docs_to_add array<string>"


def planned(replies: DataFrame, history: DataFrame, enough: int = 5, alike: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(question_id, can_answer) and the gaps (question_id, place, gap_id, description, label, entities, edges, status, attempts).

    ``replies`` has n_docs beside the reply: where the call failed, a question with ``enough`` documents can be
    answered. ``history`` has question_id, description, status and attempts of earlier gaps: a gap whose words are
    like an exhausted one is left out, one that is like another takes over its status and attempts.
    """
    v = F.from_json(json_text("reply", "can_answer"), _PLAN)
    parsed = replies.select("question_id", "n_docs", F.col("reply").isNull().alias("failed"), v.alias("v"))
    answer = parsed.select("question_id", F.when(F.col("failed"), F.col("n_docs") >= enough).otherwise(F.coalesce("v.can_answer", F.lit(False))).alias("can_answer"))
    open_ = parsed.filter("NOT failed AND NOT coalesce(v.can_answer, false)").select("question_id", F.posexplode("v.info_gaps").alias("place", "g"))
    gaps = open_.select("question_id", "place", F.coalesce("g.gap_id", F.concat(F.lit("gap_"), (F.col("place") + 1).cast("string"))).alias("gap_id"), F.coalesce("g.gap_description", F.lit("")).alias("description"), F.coalesce("g.intent_label", F.lit("Bridge_Entity")).alias("label"), F.coalesce("g.related_entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("g.active_edges", F.array().cast("array<string>")).alias("edges"))
    near = gaps.select("question_id", "place", "description").join(history.select("question_id", F.col("description").alias("old"), "status", "attempts"), "question_id").withColumn("s", jaccard(words_lower("description"), words_lower("old"))).filter(F.col("s") >= alike)
    best = near.groupBy("question_id", "place").agg(F.max(F.struct("s", "attempts", "status")).alias("b"))
    met = gaps.join(best, ["question_id", "place"], "left").filter("b IS NULL OR b.status <> 'exhausted'")
    return answer, met.select("question_id", "place", "gap_id", "description", "label", "entities", "edges", F.coalesce("b.status", F.lit("pending")).alias("status"), F.coalesce("b.attempts", F.lit(0)).alias("attempts"))


def rewritten(gaps: DataFrame, replies: DataFrame) -> DataFrame:
    """(question_id, place, query): the rewriting of each gap by its place; the description where there is none."""
    v = F.from_json(json_text("reply", "queries"), "queries array<struct<index:int,query:string>>")
    told = replies.select("question_id", F.posexplode(v["queries"]).alias("at", "q")).filter("trim(coalesce(q.query, '')) <> ''")
    last = told.groupBy("question_id", F.col("q.index").alias("place")).agg(F.max_by("q.query", "at").alias("query"))
    return gaps.join(last, ["question_id", "place"], "left").select("question_id", "place", F.coalesce("query", "description").alias("query"))


def anchor_batches(candidates: DataFrame, one_call: int = 15, size: int = 10) -> DataFrame:
    """Candidates (question_id, node_id, pos from 1) with batch: one for up to ``one_call``, else ``size`` in each."""
    n = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    return candidates.withColumn("batch", F.when(n <= one_call, 0).otherwise(F.floor((F.col("pos") - 1) / size)).cast("int"))


def validated(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """(question_id, node_id): candidates (with batch) their batch's reply names; all of a batch whose call failed."""
    v = F.from_json(json_text("reply", "valid_anchors"), "valid_anchors array<string>")
    told = replies.select("question_id", "batch", F.col("reply").isNotNull().alias("ok"), F.coalesce(v["valid_anchors"], F.array().cast("array<string>")).alias("named"))
    met = candidates.join(told, ["question_id", "batch"], "left")
    return met.filter(~F.coalesce("ok", F.lit(False)) | F.array_contains("named", F.col("node_id"))).select("question_id", "node_id").distinct()


def evaluated(gaps: DataFrame, replies: DataFrame, documents: DataFrame, most_attempts: int = 2, on_failure: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new state of gaps, the documents to add, and the hints for the next round.

    ``gaps`` has question_id, gap_id and attempts; ``documents`` question_id, doc_id and pos, what was retrieved.
    States: (question_id, gap_id, status, attempts) of the gaps a reply speaks of, an equi-join; unknown gap ids
    are passed over. Documents: (question_id, doc_id, place) of the retrieved ones in the order of the reply; the first
    ``on_failure`` where the call failed. Hints: (question_id, gap_id, hint).
    """
    v = F.from_json(json_text("reply", "intent_evaluation"), _EVALUATION)
    parsed = replies.select("question_id", F.col("reply").isNull().alias("failed"), v.alias("v"))
    said = parsed.select("question_id", F.posexplode("v.intent_evaluation").alias("at", "e")).groupBy("question_id", F.col("e.gap_id").alias("gap_id")).agg(F.max_by("e", "at").alias("e"))
    tried = gaps.join(said, ["question_id", "gap_id"]).withColumn("attempts", F.col("attempts") + 1)
    status = F.when(F.col("e.status").isin("satisfied", "partially_satisfied", "manually_closed"), F.col("e.status")).when(F.col("attempts") >= most_attempts, "exhausted").otherwise("active")
    states = tried.select("question_id", "gap_id", status.alias("status"), "attempts")
    hints = tried.filter(F.coalesce("e.status", F.lit("continue")).isin("continue", "partially_satisfied") & (F.coalesce("e.next_hint", F.lit("")) != "")).select("question_id", "gap_id", F.col("e.next_hint").alias("hint"))
    listed = parsed.select("question_id", F.posexplode("v.docs_to_add").alias("place", "doc_id")).join(documents.select("question_id", "doc_id").distinct(), ["question_id", "doc_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("pos", "doc_id"))
    first = documents.join(parsed.filter("failed").select("question_id"), "question_id", "left_semi").withColumn("place", place - 1).filter(F.col("place") < on_failure)
    added = listed.select("question_id", "doc_id", "place").unionByName(first.select("question_id", "doc_id", "place"))
    return states, added.groupBy("question_id", "doc_id").agg(F.min("place").alias("place")), hints


def upsert_states(history: DataFrame, new: DataFrame) -> DataFrame:
    """The history with the new states in place of old ones of the same gap."""
    return history.join(new.select("question_id", "gap_id"), ["question_id", "gap_id"], "left_anti").select(*new.columns).unionByName(new)


def with_status(states: DataFrame, *status: str) -> DataFrame:
    """Gaps in one of the states: active, exhausted, satisfied and so on."""
    return states.filter(F.col("status").isin(list(status)))


def answered(replies: DataFrame, fallback: DataFrame) -> DataFrame:
    """(question_id, answer, short_answer, confidence) from replies {answer, short_answer, confidence} or plain text.

    A reply that is no JSON is read line by line with a lower confidence; where the call failed, ``fallback``
    (question_id, answer) answers with confidence 0. An empty short answer is made of the answer.
    """
    v = F.from_json(json_text("reply", "answer"), "answer string, short_answer string, confidence double")
    rows = replies.select("question_id", "reply", v.alias("v"), fallback_answer(F.col("reply")).alias("f")).join(fallback.select("question_id", F.col("answer").alias("fallback")), "question_id", "left")
    structured = F.col("v.answer").isNotNull()
    natural = F.when(structured, F.col("v.answer")).when(F.col("reply").isNotNull(), F.col("f.answer")).otherwise(F.coalesce("fallback", F.lit("")))
    confidence = F.when(structured, F.coalesce("v.confidence", F.lit(0.7))).when(F.col("reply").isNotNull(), F.col("f.confidence")).otherwise(0.0)
    short = F.coalesce(F.nullif(clean_short_answer("v.short_answer"), F.lit("")), clean_short_answer(natural))
    return rows.select("question_id", natural.alias("answer"), short.alias("short_answer"), confidence.alias("confidence"))


def short_answers(replies: DataFrame, natural: str = "answer") -> DataFrame:
    """(question_id, short_answer) of replies in the form of a thought and an answer line; ``natural`` is the way out."""
    return replies.select("question_id", reply_answer(F.col("reply"), F.col(natural)).alias("short_answer"))


def recent_rounds(trace: DataFrame, rounds: int, line: Column) -> DataFrame:
    """(question_id, text): the last ``rounds`` rounds of each question, a line each, oldest first."""
    latest = F.dense_rank().over(Window.partitionBy("question_id").orderBy(F.col("round").desc()))
    kept = trace.withColumn("k", latest).filter(F.col("k") <= rounds).select("question_id", "round", line.alias("line"))
    return kept.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", "line"))), lambda x: x["line"]), "\n").alias("text"))
