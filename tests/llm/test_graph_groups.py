import random

from loomgraph.llm.components import hash_to_min, link_edges
from loomgraph.llm.survivor import survivorship
from loomgraph.llm.topn import top_n


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {(min(g), x) for g in groups.values() for x in g}


def found(spark, edges, **extra):
    df = spark.createDataFrame([(a, b, "v") for a, b in edges], "src string, dst string, v string")
    return {tuple(r) for r in hash_to_min(df).collect()}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]  # a chain
    edges += [("hub", f"x{i}") for i in range(50)]
    edges += [(None, "a"), ("a", None), ("a", "a"), ("é", "é"), ("", "z"), ("k" * 5000, "z")] + edges[:5] + [(b, a) for a, b in edges[:5]]
    assert found(spark, edges) == components(edges)


def test_components_empty(spark):
    assert found(spark, []) == set() and found(spark, [("a", "a"), (None, None)]) == set()


def test_link_edges(spark):
    dec = spark.createDataFrame([("a", "b", True), ("a", "b", False), ("c", "d", None), ("e", None, True)], "id1 string, id2 string, should_link boolean")
    fused = spark.createDataFrame([(["x", None, "y", "x"],), ([None],), (None,), ([],)], "original_ids array<string>")
    assert {tuple(r) for r in hash_to_min(link_edges(dec, fused)).collect()} == {("a", "a"), ("a", "b"), ("x", "x"), ("x", "y")}


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or s != s or g == i:
            continue
        s = max(-1.7976931348623157e308, min(1.7976931348623157e308, s))
        best[g, i] = max(best.get((g, i), s), s)
    out = set()
    for g in {g for g, _ in best}:
        order = sorted(((-s, i.encode()) for (h, i), s in best.items() if h == g))[:n]
        out |= {(g, k + 1, i.decode()) for k, (_, i) in enumerate(order)}
    return out


def test_top_n_against_sorting(spark):
    rng = random.Random(2)
    rows = [("big", f"item_{rng.randint(0, 3000):05d}", rng.choice([0.5, 0.9, 0.9, 0.91])) for _ in range(3000)]
    rows += [("tie", "p" * k, 1.0) for k in range(1, 40)] + [("tie2", f"hotpot_{i}_ent_é{i}", 0.25) for i in range(30)]
    rows += [("s", "a", 1e-300), ("s", "b", -1.0), ("s", "c", float("inf")), ("s", "d", float("-inf")), ("s", "e", 0.0), ("s", "f", -0.0)]
    rows += [(None, "x", 1.0), ("n", None, 1.0), ("n", "x", None), ("n", "y", float("nan")), ("n", "n", 1.0), ("n", "", 0.5), ("n", "a\u0000b", 0.5), ("n", "a", 0.5)] + rows[:50]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, i string, s double, item_rank int")
    assert {tuple(r) for r in top_n(df, "g", "i", "s", 10).collect()} == brute_top(rows, 10)
    assert top_n(df.limit(0), "g", "i", "s", 10).count() == 0


def test_survivorship(spark):
    f = "fused_id long, group_id string, fused_text string, fused_type string, confidence double, fused_at string, text string"
    rows = [
        (1, "g", " Ann ", "person", 0.9, None, "x"), (2, "g", "Anna", "ENTITY", 0.9, "2024-01-02", "x"), (3, "g", "null", " LOCATION", 0.99, None, "x"), (3, "g", "null", " LOCATION", 0.99, None, "x"),
        (4, "h", None, None, None, None, "x"), (5, "h", "<fused_text>", "?", 0.5, None, "x"), (6, "i", "B", "EVENT", 1.7, "2024-01-01", "x"), (7, "i", "B", "EVENT", float("nan"), "2024-01-02", "x"),
        (8, None, "C", "EVENT", 0.5, None, "x"), (10, "j", "T", "DATE", 0.5, None, "x"), (9, "j", "T", "DATE", 0.5, None, "x"), (11, "k", " ", "x" * 4000, 0.1, None, "x"),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, f).withColumn("fused_at", F.col("fused_at").cast("timestamp"))
    groups = spark.createDataFrame([("g", ["Ann", "Ann ", None]), ("g", ["Ann", "Ann ", None]), ("z", None)], "group_id string, entity_texts array<string>")
    got = {tuple(r) for r in survivorship(df, groups).collect()}
    assert got == {("g", 1, 3), ("h", 0, 0), ("i", 7, 7), ("j", 9, 9), ("k", 0, 0)}
    assert survivorship(df.limit(0), groups).count() == 0 and survivorship(df, groups.limit(0)).count() == 5
