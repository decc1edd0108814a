"""Registered queries over model replies, paths, queues and the stages of the retrieval loop, each with its SQL.

Replies are made of the tables' own columns, in the forms models use, so what must come out is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from ..operators import evaluation, paths, stages
from ..operators.agent import fallback_answers as first_documents
from ..operators.agent import gap_status
from ..session import read_table
from .catalogue import _F1, _NORM, _RUNS, _documents, _runs, query


def _answers(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "answer_results").select("answer_id", "question_id", "run_id", "answer", "short_answer", "confidence", "answered_at").distinct()


def _asked(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "test_questions").select("question_id", "question", "answer", "title").distinct()


def _clean(x: str) -> str:
    strip = lambda t, c: f"regexp_replace({t}, '^[{c}]+|[{c}]+$', '', 'g')"
    t = f"coalesce({x}, '')"
    for c in ("\\s\\p{Z}", '"', "''", "\\s\\p{Z}"):
        t = strip(t, c)
    return f"trim(regexp_replace(regexp_replace({t}, '[\\s\\p{{Z}}]+', ' ', 'g'), '[。．.!！?？;；,:，]+$', ''))"


# Replies --------------------------------------------------------------------------------------------


@query("SELECT DISTINCT answer_id, CASE WHEN answer_id % 5 = 4 THEN NULL ELSE short_answer END AS value FROM answer_results")
def reply_json(s: SparkSession, d: str) -> DataFrame:
    """The answer field of replies: fenced, behind another object, inside prose with braces, in a bare fence, without JSON."""
    body = F.to_json(F.struct(F.col("short_answer").alias("answer"), F.struct(F.lit(1).alias("n")).alias("meta")))
    form = F.col("answer_id") % 5
    reply = F.when(form == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone {x}."))).when(form == 1, F.concat(F.lit('{"note": 1} then '), body)).when(form == 2, F.concat(F.lit("Given the sets { and }, it is "), body, F.lit(" as } says"))).when(form == 3, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.lit("no object here"))
    return _answers(s, d).select("answer_id", R.reply_field(reply, "answer").alias("value"))


@query(f"""WITH a AS (SELECT DISTINCT answer_id, answer, short_answer FROM answer_results),
    l AS (SELECT *, list_filter(regexp_split_to_array(coalesce(answer, ''), '[\\r\\n]+'), lambda x: trim(x) <> '') AS lines FROM a)
    SELECT answer_id, CASE WHEN answer_id % 2 = 0 AND {_clean('short_answer')} <> '' THEN {_clean('short_answer')} WHEN answer_id % 2 = 0 THEN {_clean('answer')} ELSE coalesce(nullif({_clean('lines[len(lines)]')}, ''), {_clean('answer')}) END AS short FROM l""")
def reply_short_answer(s: SparkSession, d: str) -> DataFrame:
    """Replies with an answer line, and replies of lines only."""
    return _last_lines(_answers(s, d))


def _last_lines(a: DataFrame) -> DataFrame:
    named = F.when(T.clean_short_answer("short_answer") != "", F.concat(F.lit("Thought: two documents agree.\nAnswer: "), "short_answer")).otherwise(F.lit(""))
    lines = F.filter(F.split(F.coalesce("answer", F.lit("")), r"[\r\n]+"), lambda x: F.trim(x) != "")
    # the last line alone, marked as an answer where it speaks of one itself
    plain = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    plain = F.when(plain.rlike(r"(?i)\bAnswer\s*:"), F.concat(F.lit("Answer: "), plain)).otherwise(F.concat(F.lit("first line\n"), plain))
    reply = F.when(F.col("answer_id") % 2 == 0, named).otherwise(F.when(F.size(lines) == 0, F.lit("")).otherwise(plain))
    return a.select("answer_id", R.reply_answer(reply, F.col("answer")).alias("short"))


@query("""WITH x AS (SELECT DISTINCT answer_id, answer, regexp_matches(answer, '(?i)answer["\\s:]+[^\\n]') AS named FROM answer_results)
    SELECT answer_id, regexp_replace(CASE WHEN named THEN regexp_extract(answer, '(?i)answer["\\s:]+([^\\n]+)', 1) ELSE answer END, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS said, CASE WHEN named THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM x""")
def fallback_parse(s: SparkSession, d: str) -> DataFrame:
    f = R.fallback_answer(F.col("answer"))
    return _answers(s, d).select("answer_id", f["answer"].alias("said"), f["confidence"].alias("confidence")).distinct()


@query("""WITH x AS (SELECT DISTINCT decision_id, relation_type, direction, confidence FROM linking_decisions)
    SELECT decision_id, decision_id % 3 < 2 AND relation_type IS NOT NULL AS should_link, CASE WHEN decision_id % 3 < 2 THEN relation_type END AS relation_type,
        CASE WHEN decision_id % 3 = 0 AND direction IN ('1->2', '2->1', '1<->2') THEN direction ELSE '1->2' END AS direction, CASE WHEN decision_id % 3 = 0 AND confidence IS NOT NULL AND NOT isnan(confidence) THEN confidence ELSE 0.0 END AS confidence,
        CASE WHEN decision_id % 3 = 2 THEN 'Parse failed' ELSE '' END AS reason FROM x""")
def link_replies(s: SparkSession, d: str) -> DataFrame:
    """Verdicts: fenced and whole, begun but cut off, and without any object."""
    rel = F.coalesce("relation_type", F.lit("NO_RELATION"))
    x = read_table(s, d, "linking_decisions").select("decision_id", "relation_type", "direction", "confidence").distinct()
    whole = F.concat(F.lit("```json\n"), F.to_json(F.struct(rel.alias("relation"), "direction", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"))), F.lit("\n```"))
    form = F.col("decision_id") % 3
    reply = F.when(form == 0, whole).when(form == 1, F.concat(F.lit('I think {"relation": "'), rel, F.lit('", "direction": "2->'))).otherwise(F.lit("They are related {somehow}."))
    return x.select("decision_id", R.link_decision(reply).alias("v")).select("decision_id", "v.*")


@query("""SELECT a.answer_id, 'Question: ' || coalesce(q.question, '') || chr(10) || chr(10) || 'Gold answer: ' || coalesce(q.answer, '') || chr(10) || chr(10) || 'Predicted answer: ' || coalesce(a.answer, '') || chr(10) || chr(10) || 'Is the predicted answer right? Reply with right or wrong only.' AS prompt
    FROM (SELECT DISTINCT answer_id, question_id, answer FROM answer_results) a JOIN (SELECT DISTINCT question_id, question, answer FROM test_questions) q USING (question_id)""")
def judge_prompts(s: SparkSession, d: str) -> DataFrame:
    q = _asked(s, d).select("question_id", "question", F.col("answer").alias("gold"))
    return _answers(s, d).join(q, "question_id").select("answer_id", R.judge_prompt(F.col("question"), F.col("gold"), F.col("answer")).alias("prompt"))


_FIRST_GOLD = "q AS (SELECT question_id, min(answer) AS gold FROM test_questions GROUP BY 1), a AS (SELECT DISTINCT answer_id, question_id, run_id, answer, short_answer FROM answer_results)"


@query(f"WITH {_FIRST_GOLD}, v AS (SELECT run_id, CASE WHEN contains(lower(coalesce(a.answer, '')), lower(gold)) THEN 1 ELSE 0 END AS ok FROM a JOIN q USING (question_id) WHERE gold IS NOT NULL) SELECT run_id, count(*) AS n, sum(ok)::BIGINT AS n_right, round(avg(ok) * 100, 4) AS share FROM v GROUP BY ROLLUP (run_id)")
def judged_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers judged against the first gold answer by the deterministic judge: right when the gold answer is in them."""
    gold = _asked(s, d).groupBy("question_id").agg(F.min("answer").alias("gold")).filter("gold IS NOT NULL")
    reply = F.when(F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower("gold")), "That is right.").otherwise("wrong")
    verdicts = _answers(s, d).join(gold, "question_id").select("run_id", R.judged_right(reply).alias("is_correct"))
    return evaluation.judge_summary(verdicts, "run_id")


@query(f"""WITH {_FIRST_GOLD}, tok AS (SELECT answer_id, run_id, gold, a.answer, list_filter(string_split({_NORM.format('gold')}, ' '), lambda x: x <> '') AS g, list_filter(string_split({_NORM.format('a.answer')}, ' '), lambda x: x <> '') AS p FROM a JOIN q USING (question_id)),
    sc AS (SELECT answer_id, run_id, CASE WHEN {_NORM.format('gold')} = {_NORM.format('answer')} THEN 1.0 ELSE 0.0 END AS em, CAST({_F1} AS DOUBLE) AS f1 FROM tok)
    SELECT run_id, count(*) AS n, CAST(round(avg(em) * 100, 8) AS DOUBLE) AS em, CAST(round(avg(f1) * 100, 8) AS DOUBLE) AS f1 FROM sc GROUP BY ROLLUP (run_id)""")
def eval_rollup_full(s: SparkSession, d: str) -> DataFrame:
    """Scores of the whole answers in place of the short ones."""
    gold = _asked(s, d).groupBy("question_id").agg(F.min("answer").alias("gold")).select("question_id", F.array("gold").alias("golds"))
    rows = _answers(s, d).select("answer_id", "question_id", "run_id", "answer").distinct().join(gold, "question_id").drop("question_id")
    return evaluation.summary(evaluation.scored_answers(rows, "answer"), "run_id", 8)


@query("SELECT question_id, count(*) AS n, round(avg(confidence), 6) AS mean FROM (SELECT DISTINCT answer_id, question_id, confidence FROM answer_results WHERE confidence IS NOT NULL AND NOT isnan(confidence)) GROUP BY 1")
def mean_path_score(s: SparkSession, d: str) -> DataFrame:
    a = _answers(s, d).select("answer_id", "question_id", "confidence").distinct().filter("confidence IS NOT NULL AND NOT isnan(confidence)")
    return evaluation.mean_scores(a, "question_id", "confidence")


# Paths and queues -----------------------------------------------------------------------------------


def _paths(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d).filter("docs IS NOT NULL").select("question_id", "path_rank", F.col("docs").alias("path"))


_FIRST_RUNS = f"{_RUNS}, p AS (SELECT question_id, path_rank, docs, array_to_string(docs, ' ') AS path FROM runs WHERE docs IS NOT NULL)"


@query(f"WITH {_FIRST_RUNS} SELECT question_id, CAST(path_rank AS INTEGER) AS path_rank, path FROM p x WHERE path_rank > 1 AND EXISTS (SELECT 1 FROM p y WHERE y.path_rank = 1 AND y.question_id = x.question_id AND y.docs = x.docs)")
def trie_contains(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d)
    return paths.contained(p.filter("path_rank > 1"), p.filter("path_rank = 1")).select("question_id", "path_rank", F.array_join("path", " ").alias("path"))


@query(f"WITH {_FIRST_RUNS} SELECT question_id, CAST(path_rank AS INTEGER) AS path_rank, path FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.path_rank = 1 AND y.question_id = x.question_id AND y.docs = x.docs)")
def trie_remove(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d)
    return paths.removed(p, p.filter("path_rank = 1")).select("question_id", "path_rank", F.array_join("path", " ").alias("path"))


_PREFIX = f"{_FIRST_RUNS}, pre AS (SELECT DISTINCT question_id, docs[1:2] AS prefix FROM p WHERE len(docs) > 0)"


@query(f"WITH {_PREFIX} SELECT p.question_id, CAST(path_rank AS INTEGER) AS path_rank, array_to_string(prefix, ' ') AS prefix FROM p JOIN pre ON pre.question_id = p.question_id AND p.docs[1:len(prefix)] = prefix")
def prefixed_paths(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d).filter("size(path) > 0 AND path[0] IS NOT NULL")
    pre = p.select("question_id", F.slice("path", 1, 2).alias("prefix")).distinct()
    return paths.with_prefixes(p, pre).select("question_id", "path_rank", F.array_join("prefix", " ").alias("prefix"))


@query(f"WITH {_PREFIX} SELECT pre.question_id, array_to_string(prefix, ' ') AS prefix, count(DISTINCT p.docs) AS n FROM pre LEFT JOIN p ON pre.question_id = p.question_id AND p.docs[1:len(prefix)] = prefix GROUP BY ALL")
def prefix_counts(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d).filter("size(path) > 0 AND path[0] IS NOT NULL")
    pre = p.select("question_id", F.slice("path", 1, 2).alias("prefix")).distinct()
    return paths.prefix_counts(p, pre).select("question_id", F.array_join("prefix", " ").alias("prefix"), "n")


@query(f"""WITH {_FIRST_RUNS}, h AS (SELECT DISTINCT question_id, docs[1:i] AS head FROM (SELECT question_id, docs, unnest(range(1, len(docs) + 1)) AS i FROM p))
    SELECT p.question_id, (SELECT count(*) + 1 FROM h WHERE h.question_id = p.question_id) AS nodes, count(DISTINCT docs) AS unique_paths, count(*) AS attempts FROM p GROUP BY 1""")
def trie_stats(s: SparkSession, d: str) -> DataFrame:
    return paths.trie_statistics(_paths(s, d))


@query(f"""WITH {_RUNS}, k AS (SELECT DISTINCT doc_key FROM documents WHERE lower(trim(lang)) = 'en'), m AS (SELECT question_id, path_rank, max(pos) AS pos FROM hits WHERE doc_id IN (SELECT doc_key FROM k) GROUP BY 1, 2)
    SELECT r.question_id, CAST(r.path_rank AS INTEGER) AS path_rank, h.doc_id AS last FROM (SELECT * FROM runs WHERE docs IS NOT NULL) r LEFT JOIN m USING (question_id, path_rank) LEFT JOIN hits h ON h.question_id = m.question_id AND h.path_rank = m.path_rank AND h.pos = m.pos""")
def last_of_kind(s: SparkSession, d: str) -> DataFrame:
    kinds = _documents(s, d).select(F.col("doc_key").alias("node_id"), F.lower(F.trim("lang")).alias("node_type"))
    return paths.last_of_kind(_paths(s, d), kinds, "en").select("question_id", "path_rank", "last")


@query(f"""WITH {_FIRST_RUNS}, u AS (SELECT DISTINCT question_id, docs, path FROM p), e AS (SELECT question_id, docs, path, unnest(docs) AS doc FROM u),
    f AS (SELECT question_id, doc, min(struct_pack(a := -len(docs), b := path)) AS o FROM e GROUP BY 1, 2)
    SELECT DISTINCT u.question_id, u.path FROM u JOIN f ON f.question_id = u.question_id AND f.o = struct_pack(a := -len(u.docs), b := u.path)""")
def uncovered_paths(s: SparkSession, d: str) -> DataFrame:
    return paths.uncovered(_paths(s, d)).select("question_id", F.array_join("path", " ").alias("path"))


_SCORED = f"{_RUNS}, sc AS (SELECT r.question_id, a.run_id, r.answer_id, array_to_string(docs, ' ') AS path, coalesce(CASE WHEN isnan(a.confidence) THEN NULL ELSE a.confidence END, 0.0) AS raw_score FROM runs r JOIN (SELECT DISTINCT answer_id, run_id, confidence FROM answer_results) a USING (answer_id) WHERE docs IS NOT NULL)"


def _scored_paths(s: SparkSession, d: str) -> DataFrame:
    a = read_table(s, d, "answer_results").select("answer_id", "run_id", "confidence").distinct()
    return _runs(s, d).filter("docs IS NOT NULL").join(a, "answer_id").select("question_id", "run_id", "answer_id", F.col("docs").alias("path"), F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0)).alias("raw_score"))


@query(f"WITH {_SCORED} SELECT question_id, path, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY raw_score DESC, path) AS k FROM sc) WHERE k <= 4")
def pruned_paths(s: SparkSession, d: str) -> DataFrame:
    return paths.pruned(_scored_paths(s, d), 4).select("question_id", F.array_join("path", " ").alias("path"), "raw_score")


@query(f"WITH {_SCORED} SELECT question_id, run_id, path, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id, run_id ORDER BY raw_score DESC, path) AS k FROM sc) WHERE k <= 2")
def pruned_group_paths(s: SparkSession, d: str) -> DataFrame:
    return paths.pruned(_scored_paths(s, d), 2, "run_id").select("question_id", "run_id", F.array_join("path", " ").alias("path"), "raw_score")


@query(f"""WITH {_FIRST_RUNS} SELECT a.question_id, CAST(a.path_rank AS INTEGER) AS path_rank, round(CASE WHEN len(list_distinct(a.docs || b.docs)) = 0 THEN 0.0 ELSE len(list_intersect(a.docs, b.docs)) / len(list_distinct(a.docs || b.docs)) END, 6) AS similarity
    FROM p a JOIN p b ON a.question_id = b.question_id AND b.path_rank = a.path_rank + 1 WHERE NOT list_contains(list_transform(a.docs || b.docs, lambda x: x IS NULL), true)""")
def path_similarity(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d).filter(~F.exists("path", lambda x: x.isNull()))
    q = p.select("question_id", (F.col("path_rank") - 1).alias("path_rank"), F.col("path").alias("other"))
    return p.join(q, ["question_id", "path_rank"]).select("question_id", "path_rank", F.round(paths.path_similarity(F.col("path"), F.col("other")), 6).alias("similarity"))


@query(f"""WITH {_RUNS}, c AS (SELECT question_id, doc_id, min(path_rank * 100 + pos) AS came FROM hits WHERE doc_id IS NOT NULL GROUP BY 1, 2),
    v AS (SELECT h.question_id, h.doc_id FROM hits h WHERE path_rank = 1), n AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.question_id = c.question_id AND v.doc_id = c.doc_id))
    SELECT question_id, doc_id, CAST(1000.0 / came AS DOUBLE) AS priority, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY 1000.0 / came DESC, doc_id) AS place FROM n) WHERE place <= 8""")
def anchor_queue(s: SparkSession, d: str) -> DataFrame:
    """Documents of later runs as anchors, earlier ones of higher priority, those of the first run visited."""
    hits = _runs(s, d).select("question_id", "path_rank", F.posexplode("docs").alias("pos", "node_id")).filter("node_id IS NOT NULL")
    came = F.col("path_rank") * 100 + F.col("pos")
    anchors = hits.select("question_id", "node_id", came.alias("came"), (F.lit(1000.0) / came).alias("priority"))
    queue = paths.bounded_queue(anchors, 8, hits.filter("path_rank = 1").select("question_id", "node_id").distinct())
    return queue.select("question_id", F.col("node_id").alias("doc_id"), "priority", F.col("place").cast("int").alias("place"))


@query(f"""WITH {_RUNS}, c AS (SELECT question_id, doc_id, min(struct_pack(a := path_rank, b := pos)) AS o FROM hits WHERE doc_id IS NOT NULL GROUP BY 1, 2)
    SELECT question_id, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY o.a, o.b, doc_id) AS place FROM c) WHERE place <= 20""")
def evidence_first20(s: SparkSession, d: str) -> DataFrame:
    hits = _runs(s, d).select("question_id", "path_rank", F.posexplode("docs").alias("pos", "doc_id")).filter("doc_id IS NOT NULL")
    ordered = paths.first_in_order(hits, "question_id", "doc_id", ["path_rank", "pos"])
    return ordered.select("question_id", "doc_id", F.col("place").cast("int").alias("place")).filter("place <= 20")


@query(f"""WITH {_RUNS} SELECT r.question_id, CAST(r.path_rank AS INTEGER) AS path_rank, coalesce(string_agg(DISTINCT doc_id, ' ' ORDER BY doc_id), '') AS docs FROM (SELECT * FROM runs WHERE docs IS NOT NULL) r LEFT JOIN hits h USING (question_id, path_rank) GROUP BY 1, 2""")
def path_documents(s: SparkSession, d: str) -> DataFrame:
    """The distinct documents a path covers."""
    covered = F.array_sort(F.array_distinct(F.filter("path", lambda x: x.isNotNull())))
    return _paths(s, d).select("question_id", "path_rank", F.array_join(covered, " ").alias("docs"))


@query(f"WITH {_FIRST_RUNS} SELECT question_id, CAST(path_rank AS INTEGER) AS path_rank, coalesce((SELECT string_agg((h.pos + 1) || '. ' || h.doc_id, chr(10) ORDER BY h.pos) FROM hits h WHERE h.question_id = p.question_id AND h.path_rank = p.path_rank AND h.doc_id IS NOT NULL), '') AS text FROM p WHERE NOT list_contains(list_transform(docs, lambda x: x IS NULL), true)")
def numbered_evidence(s: SparkSession, d: str) -> DataFrame:
    p = _paths(s, d).filter(~F.exists("path", lambda x: x.isNull()))
    return p.select("question_id", "path_rank", T.numbered_lines("path").alias("text"))


# Stages ---------------------------------------------------------------------------------------------

_STATES = """st AS (SELECT question_id, count(*) AS attempts, CASE WHEN count(*) FILTER (short_answer IS NOT NULL AND confidence >= 0.8) > 0 THEN 'satisfied' WHEN count(*) FILTER (short_answer IS NOT NULL) > 0 THEN 'partially_satisfied' WHEN count(*) >= 2 THEN 'exhausted' ELSE 'active' END AS status
    FROM (SELECT DISTINCT answer_id, question_id, short_answer, confidence FROM answer_results) GROUP BY 1)"""


def _states(s: SparkSession, d: str) -> DataFrame:
    a = _answers(s, d).select("answer_id", "question_id", "short_answer", "confidence").distinct()
    return gap_status(a, "question_id", F.col("short_answer").isNotNull() & (F.col("confidence") >= 0.8), F.col("short_answer").isNotNull())


@query(f"WITH {_STATES} SELECT q.question_id, '- gap: ' || coalesce(question, '') || chr(10) || '  status: ' || status || chr(10) || '  attempts: ' || attempts || chr(10) || '  documents: ' || attempts AS text FROM st JOIN (SELECT DISTINCT question_id, question FROM test_questions) q USING (question_id)")
def gap_contexts(s: SparkSession, d: str) -> DataFrame:
    q = _asked(s, d).select("question_id", F.coalesce("question", F.lit("")).alias("question")).distinct()
    return _states(s, d).join(q, "question_id").select("question_id", R.gap_context(F.col("question"), F.col("status"), F.col("attempts"), F.col("attempts")).alias("text"))


@query(f"WITH {_RUNS}, t AS (SELECT question_id, path_rank, path_rank || ': ' || coalesce(array_to_string(docs, ' '), '') AS line, row_number() OVER (PARTITION BY question_id ORDER BY path_rank DESC) AS k FROM runs) SELECT question_id, string_agg(line, chr(10) ORDER BY path_rank) AS text FROM t WHERE k <= 3 GROUP BY 1")
def recent_rounds(s: SparkSession, d: str) -> DataFrame:
    trace = _runs(s, d).select("question_id", F.col("path_rank").alias("round"), "docs")
    return stages.recent_rounds(trace, 3, F.concat(F.col("round").cast("string"), F.lit(": "), F.coalesce(F.array_join("docs", " "), F.lit(""))))


@query(f"WITH {_STATES} SELECT question_id, status FROM st WHERE status IN ('active', 'exhausted')")
def unmet_gaps(s: SparkSession, d: str) -> DataFrame:
    return stages.with_status(_states(s, d), "active", "exhausted").select("question_id", "status")


_PLANS = f"""{_STATES}, q AS (SELECT DISTINCT question_id, coalesce(question, '') AS question, title FROM test_questions),
    w AS (SELECT q.*, st.status, st.attempts, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\\s+'), lambda x: x <> '')) AS b FROM q LEFT JOIN st USING (question_id)),
    gap AS (SELECT question_id, CAST(0 AS INTEGER) AS place, 'gap_1' AS gap_id, question AS description, len(a) > 0 AND status IS NOT NULL AS met, status, attempts FROM w WHERE question_id % 3 > 0
            UNION ALL SELECT question_id, 1, 'named', coalesce(title, ''), status IS NOT NULL AND len(list_distinct(a || b)) > 0 AND len(list_intersect(a, b)) / len(list_distinct(a || b)) >= 0.85, status, attempts FROM w WHERE question_id % 3 = 1)"""


def _plans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Replies of a planner: every third question can be answered, the next has two gaps, the third one gap; the
    earlier attempts at a question are the history of a gap with its words."""
    one = F.struct(F.lit(None).cast("string").alias("gap_id"), F.coalesce("question", F.lit("")).alias("gap_description"))
    two = F.struct(F.lit("named").alias("gap_id"), F.col("title").alias("gap_description"))
    form = F.col("question_id") % 3
    gaps = F.when(form == 1, F.array(one, two)).when(form == 2, F.array(one)).otherwise(F.array().cast("array<struct<gap_id:string,gap_description:string>>"))
    reply = F.concat(F.lit("Let me see {...}\n```json\n"), F.to_json(F.struct((form == 0).alias("can_answer"), gaps.alias("info_gaps"))), F.lit("\n```"))
    q = _asked(s, d).select("question_id", "question", "title").distinct()
    history = _states(s, d).join(q.select("question_id", F.coalesce("question", F.lit("")).alias("description")), "question_id")
    return stages.planned(q.select("question_id", reply.alias("reply"), F.lit(0).alias("n_docs")), history)


@query(f"WITH {_PLANS} SELECT question_id, place, gap_id, description, CASE WHEN met THEN status ELSE 'pending' END AS status, CASE WHEN met THEN attempts ELSE 0 END AS attempts FROM gap WHERE NOT (met AND status = 'exhausted')")
def planned_gaps(s: SparkSession, d: str) -> DataFrame:
    return _plans(s, d)[1].select("question_id", "place", "gap_id", "description", "status", F.col("attempts").cast("long").alias("attempts"))


@query("SELECT question_id, question_id % 3 = 0 OR (question_id % 7 = 0 AND question_id % 2 = 0) AS can_answer FROM (SELECT DISTINCT question_id FROM test_questions)")
def planned_answerable(s: SparkSession, d: str) -> DataFrame:
    """Every seventh call fails: such a question counts as answerable with five documents, which even ids have."""
    q = _asked(s, d).select("question_id").distinct()
    body = F.to_json(F.struct((F.col("question_id") % 3 == 0).alias("can_answer")))
    failed = (F.col("question_id") % 7 == 0) & (F.col("question_id") % 3 != 0)
    replies = q.select("question_id", F.when(~failed, body).alias("reply"), F.when(F.col("question_id") % 2 == 0, 5).otherwise(4).alias("n_docs"))
    return stages.planned(replies, s.createDataFrame([], "question_id long, description string, status string, attempts long"))[0]


@query(f"WITH {_PLANS} SELECT question_id, place, CASE WHEN place = 0 AND question_id % 2 = 0 THEN 'who: ' || description ELSE description END AS query FROM gap WHERE NOT (met AND status = 'exhausted')")
def rewritten_queries(s: SparkSession, d: str) -> DataFrame:
    """The first gap of even questions is rewritten, beside an index that no gap has and an empty query."""
    gaps = _plans(s, d)[1]
    said = F.array(F.struct(F.lit(0).alias("index"), F.concat(F.lit("who: "), "description").alias("query")), F.struct(F.lit(1).alias("index"), F.lit(" ").alias("query")), F.struct(F.lit(9).alias("index"), F.lit("x").alias("query")))
    replies = gaps.filter("place = 0 AND question_id % 2 = 0").select("question_id", F.to_json(F.struct(said.alias("queries"))).alias("reply"))
    return stages.rewritten(gaps, replies)


_CANDIDATES = f"{_RUNS}, c AS (SELECT question_id, doc_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o.a, o.b, doc_id) AS BIGINT) AS pos, count(*) OVER (PARTITION BY question_id) AS n FROM (SELECT question_id, doc_id, min(struct_pack(a := path_rank, b := pos)) AS o FROM hits WHERE doc_id IS NOT NULL GROUP BY 1, 2)), b AS (SELECT *, CASE WHEN n <= 15 THEN 0 ELSE (pos - 1) // 10 END AS batch FROM c)"


@query(f"WITH {_CANDIDATES} SELECT question_id, doc_id FROM b WHERE (question_id + batch) % 5 = 0 OR doc_id LIKE 'hotpot%'")
def validated_anchors(s: SparkSession, d: str) -> DataFrame:
    """Candidates judged in batches; replies name those of one data set and one that is no candidate, every fifth call fails."""
    hits = _runs(s, d).select("question_id", "path_rank", F.posexplode("docs").alias("pos", "doc_id")).filter("doc_id IS NOT NULL")
    cand = paths.first_in_order(hits, "question_id", "doc_id", ["path_rank", "pos"]).select("question_id", F.col("doc_id").alias("node_id"), F.col("place").alias("pos"))
    batches = stages.anchor_batches(cand)
    named = F.concat(F.collect_list(F.when(F.col("node_id").startswith("hotpot"), F.col("node_id"))), F.array(F.lit("no_such_node")))
    replies = batches.groupBy("question_id", "batch").agg(named.alias("valid_anchors")).select("question_id", "batch", F.when((F.col("question_id") + F.col("batch")) % 5 != 0, F.concat(F.lit("These hold: "), F.to_json(F.struct("valid_anchors")))).alias("reply"))
    return stages.validated(batches, replies).select("question_id", F.col("node_id").alias("doc_id"))


def _evaluation(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluations of one gap a question by the confidence of its first answer, with a gap that nobody asked for; the
    documents to add are those of the first run from the last to the first, and one that was not retrieved."""
    first = _runs(s, d).filter("path_rank = 1")
    conf = _answers(s, d).select("answer_id", "confidence").distinct()
    rows = first.join(conf, "answer_id")
    status = F.when(F.col("confidence") >= 0.9, "satisfied").when(F.col("confidence") >= 0.7, "partially_satisfied").when(F.col("confidence") >= 0.6, "manually_closed").otherwise("continue")
    said = F.array(F.struct(F.lit("g").alias("gap_id"), status.alias("status"), F.lit("look at dates").alias("next_hint")), F.struct(F.lit("unknown").alias("gap_id"), F.lit("satisfied").alias("status"), F.lit("").alias("next_hint")))
    docs = F.filter(F.coalesce("docs", F.array().cast("array<string>")), lambda x: x.isNotNull())
    reply = F.to_json(F.struct(said.alias("intent_evaluation"), F.concat(F.array(F.lit("not_there")), F.reverse(docs)).alias("docs_to_add")))
    replies = rows.select("question_id", F.when(F.col("question_id") % 4 != 0, reply).alias("reply"))
    gaps = first.select("question_id", F.lit("g").alias("gap_id"), (F.col("question_id") % 2).alias("attempts"))
    got = first.select("question_id", F.posexplode("docs").alias("pos", "doc_id")).filter("doc_id IS NOT NULL").groupBy("question_id", "doc_id").agg(F.min("pos").alias("pos"))
    return stages.evaluated(gaps, replies, got)


_JUDGED = f"{_RUNS}, e AS (SELECT r.question_id, r.docs, a.confidence FROM runs r JOIN (SELECT DISTINCT answer_id, confidence FROM answer_results) a USING (answer_id) WHERE path_rank = 1)"


@query(f"WITH {_JUDGED} SELECT question_id, CASE WHEN confidence >= 0.9 THEN 'satisfied' WHEN confidence >= 0.7 THEN 'partially_satisfied' WHEN confidence >= 0.6 THEN 'manually_closed' WHEN question_id % 2 = 1 THEN 'exhausted' ELSE 'active' END AS status, question_id % 2 + 1 AS attempts FROM e WHERE question_id % 4 <> 0")
def evaluated_gaps(s: SparkSession, d: str) -> DataFrame:
    return _evaluation(s, d)[0].select("question_id", "status", "attempts")


@query(f"""WITH {_JUDGED}, h AS (SELECT question_id, doc_id, min(pos) AS pos, max(pos) AS last FROM hits WHERE path_rank = 1 AND doc_id IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos, doc_id) AS n FROM h) SELECT question_id, doc_id FROM k WHERE question_id % 4 <> 0 OR n <= 3""")
def added_documents(s: SparkSession, d: str) -> DataFrame:
    return _evaluation(s, d)[1].select("question_id", "doc_id")


@query(f"WITH {_JUDGED} SELECT question_id, 'look at dates' AS hint FROM e WHERE question_id % 4 <> 0 AND NOT coalesce(confidence >= 0.9 OR (confidence < 0.7 AND confidence >= 0.6), false)")
def next_hints(s: SparkSession, d: str) -> DataFrame:
    return _evaluation(s, d)[2].select("question_id", "hint")


@query(f"""WITH {_STATES}, n AS (SELECT question_id, 'satisfied' AS status, attempts + 1 AS attempts FROM st WHERE question_id % 2 = 0) SELECT question_id, coalesce(n.status, st.status) AS status, coalesce(n.attempts, st.attempts) AS attempts FROM st LEFT JOIN n USING (question_id)""")
def upserted_gaps(s: SparkSession, d: str) -> DataFrame:
    old = _states(s, d).withColumn("gap_id", F.lit("g"))
    new = old.filter("question_id % 2 = 0").select("question_id", "gap_id", F.lit("satisfied").alias("status"), (F.col("attempts") + 1).alias("attempts"))
    return stages.upsert_states(old, new).select("question_id", "status", "attempts")


@query("""WITH ev AS (SELECT DISTINCT answer_id, question_id, confidence FROM answer_results), g AS (SELECT DISTINCT question_id, title FROM test_questions WHERE title IS NOT NULL) SELECT ev.answer_id, g.title FROM ev JOIN g USING (question_id)""")
def gap_evaluations(s: SparkSession, d: str) -> DataFrame:
    """Evaluations met with the gaps they speak of; those of no known gap are passed over."""
    gaps = _asked(s, d).filter("title IS NOT NULL").select("question_id", "title").distinct()
    return _answers(s, d).select("answer_id", "question_id").distinct().join(gaps, "question_id").select("answer_id", "title")


_FALLBACK = f"""{_RUNS}, fd AS (SELECT question_id, doc_id, CAST(pos AS BIGINT) AS came FROM (SELECT question_id, doc_id, min(pos) AS pos FROM hits WHERE path_rank = 1 AND doc_id IS NOT NULL GROUP BY 1, 2)),
    fk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY came, doc_id) AS rn FROM fd),
    fb AS (SELECT question_id, string_agg(coalesce(d.title, fk.doc_id) || ': ' || coalesce(substr(coalesce(d.text, ''), 1, 200), '') || '...', ' ' ORDER BY rn) AS answer FROM fk LEFT JOIN documents d ON d.doc_key = fk.doc_id WHERE rn <= 3 GROUP BY 1)"""


def _fallback(s: SparkSession, d: str) -> DataFrame:
    docs = _runs(s, d).filter("path_rank = 1").select("question_id", F.posexplode("docs").alias("at", "doc_id")).filter("doc_id IS NOT NULL").groupBy("question_id", "doc_id").agg(F.min("at").cast("long").alias("at"))
    return first_documents(docs, _documents(s, d).select(F.col("doc_key").alias("doc_id"), "title", "text"))


@query(f"WITH {_FALLBACK} SELECT question_id, answer FROM fb")
def fallback_answers(s: SparkSession, d: str) -> DataFrame:
    return _fallback(s, d)


@query(f"""WITH {_FALLBACK}, a AS (SELECT question_id, short_answer, confidence FROM (SELECT r.question_id, a.short_answer, a.confidence FROM runs r JOIN (SELECT DISTINCT answer_id, short_answer, confidence FROM answer_results) a USING (answer_id) WHERE path_rank = 1))
    SELECT a.question_id, CASE WHEN question_id % 3 = 0 THEN coalesce(fb.answer, '') WHEN short_answer IS NULL THEN 'nothing found' ELSE 'It is ' || short_answer END AS answer,
        CASE WHEN question_id % 3 = 0 THEN 0.0 WHEN short_answer IS NULL THEN 0.3 WHEN confidence IS NULL OR isnan(confidence) THEN 0.7 ELSE confidence END::DOUBLE AS confidence FROM a LEFT JOIN fb USING (question_id)""")
def final_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers from replies with JSON, from plain replies, and from the first documents where the call failed."""
    a = _runs(s, d).filter("path_rank = 1").join(_answers(s, d).select("answer_id", "short_answer", "confidence").distinct(), "answer_id")
    body = F.to_json(F.struct(F.concat(F.lit("It is "), "short_answer").alias("answer"), "short_answer", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence")))
    reply = F.when(F.col("question_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("short_answer").isNull(), F.lit("nothing found")).otherwise(F.concat(F.lit("So {here}: "), body))
    return stages.answered(a.select("question_id", reply.alias("reply")), _fallback(s, d)).select("question_id", "answer", "confidence")


@query()
def grouped_beam(s: SparkSession, d: str) -> DataFrame:
    """Two groups of starts a question, the first anchors with all edges and the rest with details only, at one width."""
    from .catalogue import _adjacency, _anchors, _norm, _prop_vectors, _questions

    group = F.when(F.col("anchor_rank") <= 5, 1).otherwise(2)
    starts = _anchors(s, d).select("question_id", group.alias("group_id"), "node_id")
    both = F.array(F.lit("SKELETON"), F.lit("DETAIL"))
    groups = starts.select("question_id", "group_id").distinct().withColumn("edges", F.when(F.col("group_id") == 1, both).otherwise(F.array(F.lit("DETAIL"))))
    found = paths.grouped_beam(starts, groups, _adjacency(s, d), _prop_vectors(s, d), _questions(s, d), _norm(s, d), 6, 4)
    return found.select("question_id", "group_id", F.array_join("path", " ").alias("path"), "raw_score", "depth")
