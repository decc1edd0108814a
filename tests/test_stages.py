import json
import random

from pyspark.sql import functions as F

from loomgraph.functions import replies as R
from loomgraph.functions.text import jaccard_pairs
from loomgraph.operators import evaluation, paths, stages


def test_json_of_replies():
    cases = [
        ('{"a": 1} then {"answer": "x"}', "answer", '{"answer": "x"}'),
        ('{"a": 1} then {"b": 2}', "answer", '{"a": 1}'),
        ('{"a": {"b": {}}} tail }', None, '{"a": {"b": {}}}'),
        ("```\n{1}\n``` and ```json\n{2}\n```", None, "{2}"),
        ("```\n[1]\n```", None, "[1]"),
        ("x { y } z", "f", "{ y }"),
        ("open { only", None, "open { only"),
        ("} {", None, "} {"),
        ("", None, ""),
        (None, None, None),
    ]
    for reply, field, want in cases:
        assert R.json_of(reply, field) == want
    deep = "{" * 5000 + "}" * 5000
    assert R.json_of("x" * 100_000 + deep) == deep


def test_answers_of_replies(spark):
    rows = [("Thought: a.\nAnswer: \"Ada  Lee.\"", "n"), ("first\nlast line!\n \n", "n"), ("", "It's so."), (None, "It's so."), ("Answer:", None)]
    df = spark.createDataFrame(rows, "reply string, natural string")
    assert [r[0] for r in df.select(R.reply_answer(F.col("reply"), F.col("natural"))).collect()] == ["Ada Lee", "last line", "It's so", "It's so", "Answer"]
    f = [tuple(r[0]) for r in df.select(R.fallback_answer(F.col("reply"))).collect()]
    assert f == [('Ada  Lee."', 0.5), ("first\nlast line!", 0.3), ("", 0.3), (None, 0.3), ("Answer:", 0.3)]
    assert [r[0] for r in spark.createDataFrame([("That is RIGHT",), ("wrong",), ("bright",), (None,)], "x string").select(R.judged_right(F.col("x"))).collect()] == [1, 0, 0, 0]


def test_link_verdicts(spark):
    rows = ['```json\n{"relation": "DETAIL", "direction": "2->1", "confidence": 0.5, "reason": "r"}\n```', 'so {"relation": "DETAIL", "direc', '{"relation": "NO_RELATION"}', "nothing", None, "```json\n{bad}\n```"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(R.link_decision(F.col("x"))).collect()]
    assert got[:3] == [(True, "DETAIL", "2->1", 0.5, "r"), (True, "DETAIL", "1->2", 0.0, ""), (False, None, "1->2", 0.0, "")]
    assert got[3:] == [(False, None, "1->2", 0.0, "Parse failed")] * 3


def test_planning(spark):
    reply = json.dumps({"can_answer": False, "info_gaps": [{"gap_description": "who built the old mill"}, {"gap_id": "x", "gap_description": "when was it closed"}, {"gap_description": "new one", "active_edges": ["DETAIL"]}]})
    replies = spark.createDataFrame([(1, reply, 0), (2, None, 5), (3, None, 4), (4, '{"can_answer": true}', 0), (5, "no json", 9)], "question_id long, reply string, n_docs int")
    history = spark.createDataFrame([(1, "Who built the old mill", "exhausted", 2), (1, "when was it closed", "partially_satisfied", 1), (9, "new one", "exhausted", 2)], "question_id long, description string, status string, attempts long")
    answer, gaps = stages.planned(replies, history)
    assert {tuple(r) for r in answer.collect()} == {(1, False), (2, True), (3, False), (4, True), (5, False)}
    got = {(r["question_id"], r["gap_id"]): (r["place"], r["status"], r["attempts"], r["edges"]) for r in gaps.collect()}
    assert got == {(1, "x"): (1, "partially_satisfied", 1, []), (1, "gap_3"): (2, "pending", 0, ["DETAIL"])}
    told = spark.createDataFrame([(1, '{"queries": [{"index": 1, "query": "closing year"}, {"index": 7, "query": "y"}, {"index": 2, "query": ""}]}'), (9, None)], "question_id long, reply string")
    assert {tuple(r) for r in stages.rewritten(gaps, told).collect()} == {(1, 1, "closing year"), (1, 2, "new one")}


def test_validation(spark):
    cand = spark.createDataFrame([(1, f"n{i}", i) for i in range(1, 24)] + [(2, "a", 1), (2, "b", 2)], "question_id long, node_id string, pos long")
    batches = stages.anchor_batches(cand)
    assert {tuple(r) for r in batches.groupBy("question_id", "batch").count().collect()} == {(1, 0, 10), (1, 1, 10), (1, 2, 3), (2, 0, 2)}
    replies = spark.createDataFrame([(1, 0, '{"valid_anchors": ["n3", "n15", "zz"]}'), (1, 1, None), (1, 2, "no"), (2, 0, '{"valid_anchors": []}')], "question_id long, batch int, reply string")
    assert {tuple(r) for r in stages.validated(batches, replies).collect()} == {(1, "n3")} | {(1, f"n{i}") for i in range(11, 21)}
    assert stages.validated(batches.limit(0), replies).count() == 0


def test_evaluation_and_states(spark):
    gaps = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 0), (1, "d", 0), (2, "a", 0)], "question_id long, gap_id string, attempts long")
    reply = {"intent_evaluation": [{"gap_id": "a", "status": "satisfied"}, {"gap_id": "b", "status": "continue", "next_hint": "h"}, {"gap_id": "c", "status": "continue"}, {"gap_id": "zz", "status": "satisfied"}], "docs_to_add": ["d2", "no", "d1", "d2"]}
    replies = spark.createDataFrame([(1, json.dumps(reply)), (2, None)], "question_id long, reply string")
    docs = spark.createDataFrame([(1, "d1", 0), (1, "d2", 1), (2, "x", 3), (2, "y", 1), (2, "z", 2), (2, "w", 0)], "question_id long, doc_id string, pos long")
    states, added, hints = stages.evaluated(gaps, replies, docs)
    assert {tuple(r) for r in states.collect()} == {(1, "a", "satisfied", 1), (1, "b", "exhausted", 2), (1, "c", "active", 1)}
    assert [r["doc_id"] for r in added.filter("question_id = 1").orderBy("place").collect()] == ["d2", "d1"] and {r["doc_id"] for r in added.filter("question_id = 2").collect()} == {"w", "y", "z"}
    assert {tuple(r) for r in hints.collect()} == {(1, "b", "h")}
    old = spark.createDataFrame([(1, "a", "active", 0), (1, "d", "active", 0)], states.schema)
    after = {(r["gap_id"], r["status"]) for r in stages.upsert_states(old, states).collect()}
    assert after == {("a", "satisfied"), ("b", "exhausted"), ("c", "active"), ("d", "active")}
    assert {r["gap_id"] for r in stages.with_status(states, "active", "exhausted").collect()} == {"b", "c"}


def test_final_answers(spark):
    replies = spark.createDataFrame([(1, '{"answer": "Ada Lee built it.", "short_answer": "\\"Ada Lee.\\"", "confidence": 0.9}'), (2, "answer: Bo\nmore"), (3, None), (4, None), (5, '{"answer": "Cy."}')], "question_id long, reply string")
    back = spark.createDataFrame([(3, "from the documents")], "question_id long, answer string")
    got = {r["question_id"]: tuple(r)[1:] for r in stages.answered(replies, back).collect()}
    assert got == {1: ("Ada Lee built it.", "Ada Lee", 0.9), 2: ("Bo", "Bo", 0.5), 3: ("from the documents", "from the documents", 0.0), 4: ("", "", 0.0), 5: ("Cy.", "Cy", 0.7)}
    trace = spark.createDataFrame([(1, r, f"r{r}") for r in (1, 2, 3, 4)], "question_id long, round int, x string")
    assert stages.recent_rounds(trace, 2, F.col("x")).first()["text"] == "r3\nr4"
    v = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "run string, is_correct int")
    assert {tuple(r) for r in evaluation.judge_summary(v, "run").collect()} == {("a", 2, 1, 50.0), ("b", 1, 1, 100.0), (None, 3, 2, 66.6667)}


def test_path_sets(spark):
    rng = random.Random(3)
    rows = [(q, [rng.choice("abcd") for _ in range(rng.randint(0, 4))]) for q in (1, 2) for _ in range(30)]
    p = spark.createDataFrame(rows, "question_id long, path array<string>")
    probe = spark.createDataFrame([rows[0], (2, ["z"])], "question_id long, path array<string>")
    assert [tuple(r) for r in paths.contained(probe, p).collect()] == [(rows[0][0], rows[0][1])]
    assert paths.removed(p, probe).count() == sum(r != rows[0] for r in rows)
    heads = [(1, ["a"]), (2, ["b", "a"]), (2, ["z"])]
    pre = spark.createDataFrame(heads, "question_id long, prefix array<string>")
    want = {(q, tuple(h)): len({tuple(x) for k, x in rows if k == q and x[: len(h)] == h}) for q, h in heads}
    assert {(r["question_id"], tuple(r["prefix"])): r["n"] for r in paths.prefix_counts(p, pre).collect()} == want
    for r in paths.trie_statistics(p).collect():
        mine = [x for q, x in rows if q == r["question_id"]]
        nodes = {tuple(x[:i]) for x in mine for i in range(len(x) + 1)} | {()}
        assert (r["nodes"], r["unique_paths"], r["attempts"]) == (len(nodes), len({tuple(x) for x in mine}), len(mine))
    for q in (1, 2):  # by the definition: from the longest down, a path all of whose nodes were seen goes
        seen, kept = set(), set()
        for x in sorted({tuple(x) for k, x in rows if k == q}, key=lambda x: (-len(x), " ".join(x))):
            if not set(x) <= seen:
                kept.add(x)
                seen |= set(x)
        assert {tuple(r["path"]) for r in paths.uncovered(p).filter(F.col("question_id") == q).collect()} == kept
    kinds = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "node_id string, node_type string")
    named = spark.createDataFrame([(1, 1, ["a", "c", "b", "c"]), (1, 2, ["c"]), (1, 3, [])], "question_id long, path_rank int, path array<string>")
    assert {r["path_rank"]: r["last"] for r in paths.last_of_kind(named, kinds, "x").collect()} == {1: "b", 2: None, 3: None}


def test_queues(spark):
    a = spark.createDataFrame([(1, "x", 1.0, 0), (1, "x", 9.0, 1), (1, "y", 2.0, 2), (1, "z", 3.0, 3), (1, "seen", 9.0, 4), (2, "x", 1.0, 0)], "question_id long, node_id string, priority double, came long")
    visited = spark.createDataFrame([(1, "seen")], "question_id long, node_id string")
    assert {tuple(r) for r in paths.bounded_queue(a, 2, visited).collect()} == {(1, "z", 3.0, 1), (1, "y", 2.0, 2), (2, "x", 1.0, 1)}
    lists = spark.createDataFrame([(1, 0, 0, "b"), (1, 0, 1, "a"), (1, 1, 0, "a"), (1, 1, 1, "c")], "k long, gap int, pos int, item string")
    assert [r["item"] for r in paths.first_in_order(lists, "k", "item", ["gap", "pos"]).orderBy("place").collect()] == ["b", "a", "c"]


def test_jaccard_pairs_against_all(spark):
    rng = random.Random(4)
    sets = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))})) for i in range(60)]
    for least in (0.3, 0.5, 1.0):
        want = {(i, j) for i, a in sets for j, b in sets if i != j and len(set(a) & set(b)) / len(set(a) | set(b)) >= least}
        df = spark.createDataFrame(sets, "id long, w array<string>")
        assert {(r["id1"], r["id2"]) for r in jaccard_pairs(df, "id", "w", least).collect()} == want


def test_grouped_beam(spark):
    edges = [("a", "DETAIL", "b"), ("a", "SKELETON", "c"), ("b", "DETAIL", "c"), ("c", "DETAIL", "d"), ("d", "DETAIL", "a")]
    adj = [(x, t, y, "proposition") for x, t, y in edges] + [(x, "MENTIONS_ENTITY", f"e_{x}", "entity") for x in "abcd"]
    adjacency = spark.createDataFrame(adj, "node_id string, edge_type string, neighbour string, neighbour_type string")
    vectors = spark.createDataFrame([(x, [1.0, i / 10]) for i, x in enumerate("abcd")], "node_id string, vec array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vec array<double>")
    starts = spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "question_id long, group_id int, node_id string")
    groups = spark.createDataFrame([(1, 1, ["DETAIL"]), (1, 2, ["SKELETON"])], "question_id long, group_id int, edges array<string>")
    run = lambda depth, width: {(r["group_id"], "".join(r["path"])): r["raw_score"] for r in paths.grouped_beam(starts, groups, adjacency, vectors, questions, 1.0, depth, width).collect()}
    one = run(1, 4)
    assert set(one) == {(1, "ab"), (2, "ac")}  # each group by its own edges
    assert all(0.69 < v <= 0.7 for v in one.values())  # 0.4 for likeness, 0.3 for a new entity
    assert set(run(1, 1)) == {max(one, key=one.get)}  # groups compete for the places
    deep = run(6, 4)
    assert set(deep) == {(1, "abcd")}  # no node twice in a path; the second group has no edge to go on
    assert paths.grouped_beam(starts.limit(0), groups, adjacency, vectors, questions, 1.0, 3, 2).count() == 0
