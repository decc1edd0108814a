import pytest

from loomgraph.config import Settings
from loomgraph.functions.vector import HashedWords
from loomgraph.operators import loop


def scripted():
    """The class is local, so that it travels to the workers by value."""
    import json
    import re

    class Scripted:
        """Replies by the task a prompt names: the mill question is answered once its document is there."""

        def generate(self, prompts):
            return [self.one(p) for p in prompts]

        def one(self, p):
            task = re.match(r"TASK: (\w+)", p).group(1)
            if "silent question" in p and task in ("plan", "answer", "validate"):
                return None
            if task == "plan":
                if "The Mill:" in p or "nobody" not in p and "mill" not in p:
                    return '{"can_answer": true}'
                return "Let me {think}: " + json.dumps({"can_answer": False, "info_gaps": [{"gap_id": "g1", "gap_description": "who built the mill", "related_entities": ["Ada Lee"]}, {"gap_description": "when did nobody come"}]})
            if task == "rewrite":
                return json.dumps({"queries": [{"index": 0, "query": "built the old mill"}]})
            if task == "validate":
                return json.dumps({"valid_anchors": [] if "nobody" in p.split("\n\n")[1] else re.findall(r"^(p\d+): ", p, re.M)})
            if task == "evaluate":
                return json.dumps({"intent_evaluation": [{"gap_id": "g1", "status": "satisfied"}, {"gap_id": "gap_2", "status": "continue"}], "docs_to_add": re.findall(r"(d\d+) \|", p)})
            return json.dumps({"answer": "Ada Lee built it.", "short_answer": "Ada Lee."}) if "The Mill:" in p else "I found nothing"

    return Scripted


@pytest.fixture(scope="module")
def known(spark):
    texts = [("p1", "d1", "Ada Lee built the old mill"), ("p2", "d1", "the old mill burnt"), ("p3", "d2", "Ada Lee met Bo"), ("p4", "d3", "tin was sold in the port")]
    model = HashedWords()
    nodes = spark.createDataFrame([(*t, model.embed([t[2]])[0]) for t in texts], "node_id string, doc_id string, text string, vec array<double>")
    ents = spark.createDataFrame([("e1", model.embed(["Ada Lee"])[0])], "node_id string, vec array<double>")
    adj = [("p1", "MENTIONS_ENTITY", "e1", "entity"), ("e1", "MENTIONS_ENTITY", "p1", "proposition"), ("p3", "MENTIONS_ENTITY", "e1", "entity"), ("e1", "MENTIONS_ENTITY", "p3", "proposition"), ("p1", "DETAIL", "p2", "proposition")]
    docs = spark.createDataFrame([("d1", "The Mill", "Ada Lee built the old mill."), ("d2", None, "They met."), ("d3", "Tin", None)], "doc_id string, title string, text string")
    return loop.Knowledge(nodes, ents, spark.createDataFrame(adj, "node_id string, edge_type string, neighbour string, neighbour_type string"), docs, 2.0)


def test_questions_are_answered(spark, known):
    q = spark.createDataFrame([(1, "Who built the old mill?"), (2, "Is it day?"), (3, "Did nobody see it?"), (4, "A silent question")], "question_id long, question string")
    out = loop.answer_questions(q, known, scripted(), HashedWords, Settings(max_rounds=2, anchor_k=2, beam_depth=2))
    ends = {r["question_id"]: (r["rounds"], r["termination"]) for r in out.summary.collect()}
    assert ends == {1: (2, "information_sufficient"), 2: (1, "information_sufficient"), 3: (1, "no_valid_anchors"), 4: (2, "max_rounds_reached")}
    answers = {r["question_id"]: (r["answer"], r["short_answer"], r["confidence"]) for r in out.answers.collect()}
    assert answers[1] == ("Ada Lee built it.", "Ada Lee", 0.7) and answers[2] == answers[3] == ("I found nothing", "I found nothing", 0.3)
    assert answers[4][2] == 0.0 and answers[4][0]  # the call failed: the first documents answer
    gaps = {(r["question_id"], r["gap_id"]): (r["status"], r["attempts"]) for r in out.gaps.collect()}
    assert gaps[(1, "g1")] == ("satisfied", 1) and gaps[(1, "gap_2")] == ("active", 1)
    assert {r["doc_id"] for r in out.documents.filter("question_id = 1").collect()} >= {"d1"}
    trace = out.trace.filter("question_id = 1").collect()
    assert {r["gap_id"] for r in trace} <= {"g1", "gap_2"} and any(r["path"][0] == "p1" for r in trace)
    nothing = loop.answer_questions(q.limit(0), known, scripted(), HashedWords, Settings(max_rounds=1))
    assert nothing.answers.count() == nothing.summary.count() == 0
