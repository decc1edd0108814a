import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluation, knn, linking, skew, traversal
from loomgraph.operators.agent import fallback_answers, gap_status, retrieve_rounds, run_rounds


def test_knn_join_exact_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8))
    v = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(60)], "item_id long, vec array<double>")
    q = v.filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vec")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for size in (64 << 20, 8 * 8 * 2):  # all queries at once, two in a block
        monkeypatch.setattr(knn, "BLOCK_BYTES", size)
        got = {}
        for r in knn.knn_join(q, v, 5).collect():
            got.setdefault(r["query_id"], {})[r["item_rank"]] = r["item_id"]
        for i in range(0, 60, 10):
            want = sorted(range(60), key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:5]
            assert [got[i][k] for k in range(1, 6)] == want
    near = knn.lsh_join(q, v, 5, threshold=0.0).count()
    assert near > 10

def test_lsh_recall_against_exact(spark):
    m = np.random.default_rng(1).standard_normal((60, 8))
    v = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(60)], "item_id long, vec array<double>")
    q = v.filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vec")
    want = {(r["query_id"], r["item_id"]) for r in knn.knn_join(q, v, 5, threshold=0.3).collect()}
    found = {(r["query_id"], r["item_id"]) for r in knn.lsh_join(q, v, 5, threshold=0.3).collect()}
    assert want and len(found & want) >= 0.9 * len(want)


def brute_leaders(lists):
    done, out = set(), set()
    for c in sorted(lists):
        if c in done or not lists[c]:
            continue
        out |= {(c, m) for m in lists[c]}
        done |= {c, *lists[c]}
    return out


def test_leader_groups_against_greedy(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{i:02d}" for i in range(25)]
        lists = {n: {x for x in rng.sample(names, rng.randint(0, 4)) if x != n} for n in names}
        df = spark.createDataFrame([(a, b) for a, bs in lists.items() for b in bs], "leader string, member string")
        assert {tuple(r) for r in linking.leader_groups(df).collect()} == brute_leaders(lists)


def test_hot_keys_join(spark):
    left = spark.range(90_000).select(F.when(F.col("id") < 60_000, F.lit("hot")).otherwise((F.col("id") % 100).cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, x int")
    hot = skew.hot_keys(left.groupBy("k").agg(F.count("*").alias("cnt")), "k")
    assert hot == ["hot"]
    for how, n in (("inner", 60_300), ("left", 90_000)):
        assert skew.join_unique(left, right, "k", hot, how).count() == n == skew.join_unique(left, right, "k", [], how).count()
    assert skew.hot_keys(left.limit(0).groupBy("k").agg(F.count("*").alias("cnt")), "k") == []


def small_graph(spark):
    adj = spark.createDataFrame(
        [("p1", "MENTIONS_ENTITY", "e1", "entity"), ("e1", "MENTIONS_ENTITY", "p1", "proposition"), ("e1", "MENTIONS_ENTITY", "p2", "proposition"), ("p2", "MENTIONS_ENTITY", "e1", "entity"), ("p2", "DETAIL", "p3", "proposition"), ("p3", "SIMILARITY", "p4", "proposition"), ("p1", "DETAIL", "p4", "proposition"), ("p3", "MENTIONS_ENTITY", "e2", "entity"), ("e2", "MENTIONS_ENTITY", "p3", "proposition")],
        "node_id string, edge_type string, neighbour string, neighbour_type string",
    )
    vec = spark.createDataFrame([("p1", "d1", [1.0, 0.0]), ("p2", "d1", [0.9, 0.1]), ("p3", "d2", [0.5, 0.5]), ("p4", "d3", [0.2, 0.8])], "node_id string, doc_id string, vec array<double>")
    return adj, vec


def test_beam_is_a_forest(spark):
    adj, vec = small_graph(spark)
    q = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "question_id long, vec array<double>, gap array<double>")
    tree = traversal.beam_search(spark.createDataFrame([(1, "p1")], "question_id long, node_id string"), adj, vec.select("node_id", "vec"), q, 1.0, depth=3, width=4)
    got = {r["node_id"]: r for r in tree.collect()}
    assert len(got) == 4 == tree.count()
    assert got["p2"]["parent"] == "p1" and got["p3"]["parent"] == "p2" and got["p4"]["parent"] == "p1"
    assert got["p3"]["path"] == ["p1", "p2", "p3"]
    paths = traversal.leaf_paths(tree)
    assert {tuple(r["path"]) for r in paths.collect()} == {("p1", "p4"), ("p1", "p2", "p3")}
    ranks = {r["path_rank"]: r["mmr_rank"] for r in traversal.mmr(paths).collect()}
    assert ranks[1] == 1 and sorted(ranks.values()) == [1, 2]
    out = run_rounds(q, adj, vec, 1.0, rounds=2, enough=2)
    assert out.first()["termination"] == "information_sufficient" and out.count() == 1


def test_entity_starts_and_refill(spark):
    adj, _ = small_graph(spark)
    start = spark.createDataFrame([(1, "e1")], "question_id long, node_id string")
    assert {r["to"] for r in traversal.neighbours(start, adj, ["DETAIL"]).collect()} == {"p1", "p2"}
    seen = spark.createDataFrame([(1, "p1")], "question_id long, node_id string")
    assert {tuple(r) for r in traversal.refill_from_entities(start, adj, seen).collect()} == {(1, "p2", 3.0)}


def test_defaults_are_those_of_production(spark):
    chain = [(f"p{i}", "DETAIL", f"p{i + 1}", "proposition") for i in range(8)]
    adj = spark.createDataFrame(chain, "node_id string, edge_type string, neighbour string, neighbour_type string")
    vec = spark.createDataFrame([(f"p{i}", f"d{i}", [1.0, 0.1 * i]) for i in range(9)], "node_id string, doc_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "question_id long, vec array<double>, gap array<double>")
    tree = traversal.beam_search(spark.createDataFrame([(1, "p0")], "question_id long, node_id string"), adj, vec.select("node_id", "vec"), q, 1.0)
    assert tree.agg(F.max("depth")).first()[0] == 6
    out = run_rounds(q, adj.limit(0), vec.limit(4), 1.0).first()
    assert (out["rounds"], out["n_docs"], out["termination"]) == (5, 4, "max_rounds_reached")


def test_rounds_reach_anchors_by_name(spark):
    near = [(f"n{i}", "d0", [1.0, 0.01 * i]) for i in range(3)]  # fill the nearest anchors and lead nowhere
    vec = spark.createDataFrame([*near, ("p9", "d9", [0.1, 1.0])], "node_id string, doc_id string, vec array<double>")
    adj = spark.createDataFrame([("p9", "MENTIONS_ENTITY", "e9", "entity"), ("e9", "MENTIONS_ENTITY", "p9", "proposition")], "node_id string, edge_type string, neighbour string, neighbour_type string")
    q = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0])], "question_id long, vec array<double>, gap array<double>")
    names = spark.createDataFrame([(1, 1, [0.0, 1.0]), (1, 2, [-1.0, 0.0])], "question_id long, pos int, vec array<double>")
    entities = spark.createDataFrame([("e9", [0.1, 1.0])], "node_id string, vec array<double>")
    without = retrieve_rounds(q, adj, vec, 1.0, rounds=1, k=3)
    assert {r["doc_id"] for r in without.documents.collect()} == {"d0"}
    out = retrieve_rounds(q, adj, vec, 1.0, rounds=1, enough=2, names=names, entities=entities, k=3)
    assert {r["doc_id"] for r in out.documents.collect()} == {"d0", "d9"} and out.summary.first()["termination"] == "information_sufficient"
    assert ["p9"] in [r["path"] for r in out.trace.collect()] and {r["n_docs"] for r in out.trace.collect()} == {2}
    texts = spark.createDataFrame([("d0", "Zero", "z" * 300), ("d9", None, "nine")], "doc_id string, title string, text string")
    answer = fallback_answers(out.documents, texts).first()["answer"]
    assert "Zero: " + "z" * 200 + "..." in answer and "z" * 201 not in answer and "d9: nine..." in answer


def test_bridge_gap_and_facts(spark):
    b = spark.createDataFrame([(0, 2.0), (1, 2.0), (9, 2.0), (3, 0.0)], "n int, norm double").select(traversal.bridge_score(F.col("n"), F.col("norm")).alias("b")).collect()
    assert [r["b"] for r in b] == [0.0, pytest.approx(0.63093, abs=1e-6), 1.0, 0.0]
    a = spark.createDataFrame([("g1", True, True), ("g2", False, True), ("g3", False, False), ("g3", False, False), ("g4", False, False)], "g string, s boolean, p boolean")
    assert {r["g"]: r["status"] for r in gap_status(a, "g", F.col("s"), F.col("p")).collect()} == {"g1": "satisfied", "g2": "partially_satisfied", "g3": "exhausted", "g4": "active"}
    s = spark.createDataFrame([(1, ["x"]), (2, ["x", "z"]), (3, []), (4, [None])], "k int, facts array<string>")
    ok = spark.createDataFrame([("x",)], "f string")
    assert {r["k"] for r in evaluation.all_facts_valid(s, ok, "k", "facts", "f").collect()} == {1, 3, 4}


def test_documents_of_paths_and_last(spark):
    r = spark.createDataFrame([(1, 1, ["a", None, "b"]), (1, 2, ["c", "a"])], "question_id long, path_rank int, docs array<string>")
    assert [(x["doc_id"], x["doc_rank"]) for x in traversal.documents_of_paths(r, 2).orderBy("doc_rank").collect()] == [("a", 1), ("b", 2)]
    k = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 9), ("q", "c", 3)], "q string, i string, o int")
    assert {x["i"] for x in traversal.keep_last(k, "q", "i", F.col("o"), 2).collect()} == {"b", "c"}
    scores = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.1, 0.5, 0.5, 0.5])], "k string, o int, s double")
    assert [x["stop"] for x in traversal.plateau(scores, "k", "o", "s", 3, 0.1).orderBy("o").collect()] == [False, False, False, True]


def test_fusion(spark):
    groups = spark.createDataFrame([("g", ["a", "b", "c"], ["Ann", "Ann B", "Ann"], ["PERSON", None, "X"], ["d", "e", "f"], [0.9, None, 0.8])] * 2, "group_id string, entity_ids array<string>, entity_texts array<string>, entity_types array<string>, doc_ids array<string>, similarities array<double>")
    members = linking.exploded_groups(groups)
    assert members.count() == 3
    assert [tuple(r) for r in linking.split_groups(members).collect()] == [("g", "judge", 0, 3)]
    fused = spark.createDataFrame([(1, "g", ["a", "b", "a", None]), (2, "g", ["b", "c"]), (3, "g", ["a", "zz"]), (4, "g", None)], "fused_id long, group_id string, original_ids array<string>")
    valid = linking.valid_fusions(fused, members)
    assert {r["id"]: r["fused_id"] for r in linking.fusion_map(valid).collect()} == {"a": 1, "b": 2, "c": 2}


def test_row_numbers_of_a_hot_key(spark):
    from loomgraph.session import Scratch

    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 30)}", rng.randint(0, 50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, score int, id long").repartition(8)
    got = {r["id"]: r["n"] for r in skew.numbered(df, ["k"], [F.col("score").desc(), F.col("id")], "n", Scratch(spark, "t")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    assert skew.numbered(df.limit(0), ["k"], [F.col("id")], "n", Scratch(spark, "t")).count() == 0
