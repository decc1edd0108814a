import datetime as dt

from pyspark.sql import functions as F

from loomgraph.operators import graph as G

T0 = dt.datetime(2024, 1, 1)


def tables(spark):
    props = spark.createDataFrame([(1, "d_prop_0", "d", 0, 0, "A met B."), (2, "d_prop_1", "d", 1, 1, "B left."), (3, "e_prop_0", "e", 0, None, "C.")], "prop_id long, node_id string, doc_id string, prop_idx int, sent_idx int, text string")
    ments = spark.createDataFrame([("d_ent_A", "d", 0, "A", "PERSON", T0), ("d_ent_B", "d", 0, "B", "PERSON", T0), ("d_ent_B", "d", 1, "B", "MISC", T0 + dt.timedelta(1)), ("e_ent_C", "e", None, "C", None, T0), ("e_ent_Z", "e", 9, "Z", None, T0)], "entity_id string, doc_id string, prop_idx int, text string, type string, seen_at timestamp")
    docs = spark.createDataFrame([("d", "Title"), ("e", None)], "doc_key string, title string")
    dec = spark.createDataFrame(
        [(1, "d_prop_0", "d_prop_1", True, "ELABORATION", "2->1", 0.5, T0), (2, "d_prop_0", "e_prop_0", True, "ODD", "1->2", 0.5, T0), (3, "d_prop_0", "d_prop_1", None, "DETAIL", "1->2", 0.5, T0), (4, "d_prop_0", "gone", True, "DETAIL", "1->2", 0.5, T0), (5, "d_prop_1", None, True, "DETAIL", None, 0.5, T0)],
        "decision_id long, id1 string, id2 string, should_link boolean, relation_type string, direction string, confidence double, decided_at timestamp",
    )
    return props, ments, docs, dec


def test_nodes_and_edges(spark):
    props, ments, docs, dec = tables(spark)
    nodes = G.nodes(props, ments, docs)
    got = {r["node_id"]: r for r in nodes.collect()}
    assert len(got) == 7
    assert got["d_ent_B"]["entity_type"] == "PERSON" and got["e_prop_0"]["title"] == ""
    edges = {(r["src"], r["dst"]): r["edge_type"] for r in G.edges(ments, dec, props).collect()}
    assert edges[("d_prop_1", "d_prop_0")] == "DETAIL" and ("d_prop_0", "d_prop_1") not in edges
    assert edges[("d_prop_0", "e_prop_0")] == edges[("e_prop_0", "d_prop_0")] == "SIMILARITY"
    assert edges[("d_prop_0", "d_ent_A")] == "MENTIONS_ENTITY" and ("e_prop_0", "e_ent_C") not in edges
    assert not [e for e in edges if "gone" in e]


def test_statistics_isolated_and_repair(spark):
    props, ments, docs, dec = tables(spark)
    nodes, edges = G.nodes(props, ments, docs), G.edges(ments, dec, props)
    assert {r["node_id"] for r in G.isolated(nodes, edges).collect()} == {"e_ent_C", "e_ent_Z"}
    stats = {r["metric"]: r["value"] for r in G.statistics(nodes, edges).collect()}
    assert stats == {"nodes_proposition": 3, "nodes_entity": 4, "edges_mentions_entity": 6, "edges_detail": 1, "edges_similarity": 2, "isolated": 2}
    one_way = edges.filter("src < dst")
    fixed = one_way.unionByName(G.repair_reverse(one_way))
    mentions = fixed.filter(F.col("edge_type") == "MENTIONS_ENTITY")
    assert mentions.count() == 6 and G.repair_reverse(fixed).count() == 0


def test_degrees_and_statistics(spark):
    props, ments, docs, dec = tables(spark)
    nodes, edges = G.nodes(props, ments, docs), G.edges(ments, dec, props)
    deg = {r["node_id"]: r["degree"] for r in G.entity_degree(nodes, edges).collect()}
    assert deg == {"d_prop_0": 2, "d_prop_1": 1, "e_prop_0": 0}
    assert tuple(G.global_statistics(G.entity_degree(nodes, edges)).first()) == (1.5, 1.5, 1.5, 2)
    none = G.global_statistics(G.entity_degree(nodes.limit(0), edges)).first()
    assert none["norm"] == 1.0 and none["count"] == 0
    meta = {r["doc_id"]: r["title"] for r in G.document_metadata(nodes, docs).collect()}
    assert meta == {"d": "Title", "e": "e"}
    alias = {r["alias"]: r["node_id"] for r in G.entity_aliases(nodes).collect()}
    assert alias["a"] == "d_ent_A"
