"""Registered queries through files: what the loaders read is written by the query first, into the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..functions.vector import norm
from ..operators import evaluation, linking
from ..session import Scratch, read_table
from ..sources import documents as sources
from ..sources import sinks
from .catalogue import _GRAPH, _PROPS, _SCORED, _decisions, _documents, _edges, _mentions, _nodes, _props, _scored, query
from .lookups import _CAND, _PACKED, _VECS, _members, _stored_vectors, proposition_candidates


def _array_file(rows: DataFrame, item: Column, order: str, path: str) -> str:
    """A JSON array in one file, of a table of fixed size."""
    one = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("j")))).alias("a"))
    one.select(F.concat(F.lit("["), F.array_join("a.j", ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


@query("SELECT 'hotpot_' || (row_number() OVER (ORDER BY question_id) - 1) AS doc_id, coalesce(title, '') AS title, coalesce(passage, '') AS content FROM (SELECT question_id, min(title) AS title, min(passage) AS passage FROM test_questions GROUP BY 1)")
def loaded_documents(s: SparkSession, d: str) -> DataFrame:
    """The held-out passages as an array of articles."""
    q = read_table(s, d, "test_questions").groupBy("question_id").agg(F.min("title").alias("title"), F.min("passage").alias("passage"))
    path = _array_file(q, F.to_json(F.struct("title", F.array(F.coalesce("passage", F.lit(""))).alias("content"))), "question_id", f"{Scratch(s, 'corpus').root}/docs")
    return sources.load_documents(s, path, "hotpot").select("doc_id", "title", F.array_join("content", "").alias("content"))


@query("SELECT 'q' || question_id AS question_id, question, coalesce(answer, '') AS gold FROM (SELECT question_id, min(question) AS question, min(answer) AS answer FROM test_questions GROUP BY 1) WHERE trim(coalesce(question, '')) <> ''")
def loaded_questions(s: SparkSession, d: str) -> DataFrame:
    q = read_table(s, d, "test_questions").groupBy("question_id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    item = F.to_json(F.struct(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("id"), "question", F.coalesce("answer", F.lit("")).alias("answer")))
    path = _array_file(q, item, "question_id", f"{Scratch(s, 'questions').root}/questions")
    return sources.load_questions(s, path).select("question_id", "question", F.array_join("golds", "").alias("gold"))


@query("SELECT doc_key AS doc_id, coalesce(title, '') AS title, md5(coalesce(text, '')) AS content FROM documents WHERE title IS NOT NULL OR text IS NOT NULL")
def loaded_lines(s: SparkSession, d: str) -> DataFrame:
    """All documents as JSON lines."""
    path = f"{Scratch(s, 'lines').root}/docs"
    _documents(s, d).select(F.col("doc_key").alias("doc_id"), "title", F.when(F.col("text").isNotNull(), F.array("text")).alias("content")).write.mode("overwrite").json(path)
    return sources.load_jsonl(s, path).select("doc_id", "title", F.md5(F.array_join("content", "")).alias("content"))


@query(f"{_GRAPH} SELECT 'nodes' AS part, node_type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY 2")
def stored_graph(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s, 'graph').root}/g"
    sinks.save_graph(_nodes(s, d), _edges(s, d), path)
    nodes, edges = sinks.load_graph(s, path)
    count = lambda df, part, kind: df.groupBy(F.col(kind).cast("string").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "nodes", "node_type").unionByName(count(edges, "edges", "edge_type"))


@query(f"""WITH {_PROPS}, first AS (SELECT DISTINCT doc_id, text FROM entities)
    SELECT 'propositions' AS part, count(*) AS n FROM props UNION ALL SELECT 'entities', count(*) FROM first UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT decision_id, id1, id2, should_link, relation_type, direction, confidence, decided_at FROM linking_decisions)""")
def exported_meta(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s, 'meta').root}/m"
    sinks.export_meta(_props(s, d), _mentions(s, d), _decisions(s, d), _nodes(s, d), _edges(s, d), path)
    count = lambda part: s.read.text(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count("propositions").unionByName(count("entities")).unionByName(count("relations"))


@query(f"WITH {_VECS} SELECT node_id, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS length FROM v")
def stored_index(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s, 'index').root}/vectors"
    sinks.save_index(_stored_vectors(s, d), path, 64)
    return sources.load_checked_index(s, path).select("node_id", F.round(norm(F.col("vec")), 6).alias("length"))


@query(f"{_CAND.replace('WITH ', _PACKED + ', ', 1)} SELECT 'auto_groups' AS part, count(DISTINCT group_id) AS n FROM r WHERE same AND n > 1 UNION ALL SELECT 'judge_groups', count(*) FROM packed WHERE kind = 'judge' UNION ALL SELECT 'pairs', count(*) FROM cand")
def stored_candidates(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s, 'candidates').root}/c"
    groups = linking.packed_groups(_members(s, d))
    sinks.save_candidates(linking.auto_fusions(_members(s, d)), groups.filter("kind = 'judge'"), proposition_candidates(s, d), path)
    stored = sources.load_artefacts(s, path, ("auto_groups", "judge_groups", "pairs"))
    auto = stored["auto_groups"].agg(F.count_distinct("group_id").alias("n")).select(F.lit("auto_groups").alias("part"), "n")
    count = lambda part: stored[part].agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return auto.unionByName(count("judge_groups")).unionByName(count("pairs"))


@query(f"WITH {_SCORED} SELECT 'details' AS part, count(DISTINCT answer_id) AS n FROM scored UNION ALL SELECT 'summary', count(DISTINCT coalesce(run_id, '?')) + 1 FROM scored")
def stored_evaluation(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s, 'evaluation').root}/e"
    scored = _scored(s, d)
    sinks.save_evaluation(scored, evaluation.summary(scored, "run_id"), path)
    count = lambda part: s.read.text(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count("details").unionByName(count("summary"))


_SAID = "p AS (SELECT DISTINCT node_id, doc_id, prop_idx, sent_idx, text FROM propositions), m AS (SELECT DISTINCT doc_id, prop_idx, text, type FROM entities WHERE prop_idx IS NOT NULL)"


def _extraction(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replies of an extractor, one a document: its propositions with their entities, and each proposition followed by the next."""
    p = _props(s, d).select("doc_id", "prop_idx", "sent_idx", "text").distinct()
    m = _mentions(s, d).filter("prop_idx IS NOT NULL").select("doc_id", "prop_idx", "text", "type").distinct()
    ents = m.groupBy("doc_id", "prop_idx").agg(F.collect_list(F.struct("text", "type")).alias("entities"))
    rows = p.join(ents, ["doc_id", "prop_idx"], "left").select("doc_id", F.struct(F.col("prop_idx").alias("id"), "text", F.col("sent_idx").alias("sentence_index"), "entities").alias("p"))
    each = rows.groupBy("doc_id").agg(F.collect_list("p").alias("propositions"))
    after = F.transform("propositions", lambda x: F.struct(x["id"].alias("source"), (x["id"] + 1).alias("target"), F.lit("SEQUENCE").alias("relation"), F.lit("backward").alias("direction")))
    reply = F.concat(F.lit("Here {it} is:\n```json\n"), F.to_json(F.struct("propositions", after.alias("relations"))), F.lit("\n```"))
    broken = s.createDataFrame([("broken", '```json\n{"propositions": [\n```'), ("silent", None)], "doc_id string, reply string")
    return models.flatten_extraction(each.select("doc_id", reply.alias("reply")).unionByName(broken))


@query(f"WITH {_SAID} SELECT DISTINCT doc_id, prop_idx, coalesce(sent_idx, -1) AS sent_idx, text FROM p")
def extracted_propositions(s: SparkSession, d: str) -> DataFrame:
    return _extraction(s, d)[0].select("doc_id", "prop_idx", F.coalesce("sent_idx", F.lit(-1)).alias("sent_idx"), "text")


@query(f"WITH {_SAID} SELECT DISTINCT m.doc_id, m.prop_idx, m.text, m.type FROM m JOIN p USING (doc_id, prop_idx)")
def extracted_entities(s: SparkSession, d: str) -> DataFrame:
    return _extraction(s, d)[1].select("doc_id", "prop_idx", "text", "type").distinct()


@query(f"WITH {_SAID} SELECT DISTINCT doc_id, prop_idx AS source, prop_idx + 1 AS target, 'SEQUENCE' AS relation, '2->1' AS direction FROM p")
def extracted_relations(s: SparkSession, d: str) -> DataFrame:
    return _extraction(s, d)[2].select("doc_id", "source", "target", "relation", "direction").distinct()


@query("SELECT doc_key AS doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\n'), lambda x: trim(x) <> '')) > 0 AS ok, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\n'), lambda x: trim(x) <> '')) AS n FROM documents")
def extracted_documents(s: SparkSession, d: str) -> DataFrame:
    """The deterministic extractor over all documents: a proposition a line."""
    docs = _documents(s, d).select(F.col("doc_key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("content"))
    props, _, _, ok = models.extract_documents(docs, models.LineExtractor, retries=0)
    n = props.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return ok.join(n, "doc_id", "left").select("doc_id", "ok", F.coalesce("n", F.lit(0)).alias("n"))
