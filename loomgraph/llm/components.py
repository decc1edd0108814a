"""Problem 1: one group id for every record linked directly or indirectly (hash-to-min)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_unique
from ..session import Scratch


def _node_keys(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, h) and edges (a, b) with 64-bit keys in place of the string ids.

    Two ids with one key would merge groups, so a seed is taken only when the keys are unique,
    which is checked over all nodes; at 10^9 nodes one seed fails in about 1 of 40 cases.
    """
    for seed in range(100):
        key = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: E731, B023
        nodes = scratch.write(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("h", key("id")), "nodes")
        clash = nodes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not clash:
            return nodes, edges.select(key("src").alias("a"), key("dst").alias("b"))
        scratch.drop(nodes)
    raise RuntimeError("no collision-free key seed found")


def hash_to_min(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected edge list of STRING ids: rows (group_id, record_id).

    Every vertex v keeps a cluster set C(v), stored as rows (v, u), at first v with its neighbours. In
    each round v sends C(v) to its smallest member m and m to all other members; what arrives is the new
    C(v). The relation is symmetric, so a vertex that holds one member only is held by that member only and
    will always share its group: it is settled, and leaves the relation with a pointer to the member. The
    rounds end when all are settled, in a stable relation everything but the smallest vertices. Pointers are
    followed by jumping. Vertices are ordered by a 64-bit hash of the id, which keeps the expected number of
    rounds logarithmic even where ids run along a chain; the group id is the smallest id string of the
    component, found by one aggregation at the end.

    The set of a hub is never held by one task: sets are rows, the smallest member is a partially
    aggregated minimum, and vertices with more than 1/64 of the rows are joined by broadcasting their one
    minimum each. Every round is a written table, so a lost executor costs a task, not the job.

    Defined cases: a null id or an edge from a node to itself links nothing (and makes no row); repeated
    or reversed edges count once; an empty input gives an empty result; other columns are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    edges = edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges = scratch.write(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    nodes, keyed = _node_keys(edges, scratch)

    pairs = keyed.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("p"))
    state = scratch.write(pairs.select(F.col("p.a").alias("v"), F.col("p.b").alias("u")).distinct(), "state")
    parents = []
    while True:
        least = scratch.write(state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("cnt")), "least")
        told = join_unique(state, least, "v", hot_keys(least, "v"))
        # a vertex that knows one member is known by that member alone: its group is settled by it
        settled = F.col("cnt") == 1
        pair = lambda x, y, gone: F.struct(F.col(x).alias("v"), F.col(y).alias("u"), gone.alias("gone"))
        sent = told.select(F.explode(F.when(settled, F.array(pair("m", "v", F.lit(True)), pair("v", "m", F.lit(True)))).otherwise(F.array(pair("m", "u", F.lit(False)), pair("u", "m", F.lit(False))))).alias("p"))
        new = scratch.write(sent.groupBy("p.v", "p.u").agg(F.max("p.gone").alias("gone")).filter("NOT gone").select("v", "u"), "state")
        parents.append(scratch.write(least.filter("cnt = 1").select("v", F.col("m").alias("root"), F.lit(len(parents)).alias("round")), "parents"))
        scratch.drop(state, least)
        del told, sent, least
        scratch.release()
        state = new
        if not state.limit(1).count():
            break
    label = scratch.write(reduce(DataFrame.unionByName, parents).groupBy("v").agg(F.max(F.struct("round", "root")).alias("r")).select("v", "r.root"), "label")
    while True:  # settled in turn: the members lead to the smallest vertex in a few jumps
        up = label.select(F.col("v").alias("root"), F.col("root").alias("top"))
        new = scratch.write(join_unique(label, up, "root", hot_keys(label.groupBy("root").agg(F.count(F.lit(1)).alias("cnt")), "root")).select("v", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "label")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(label)
        scratch.release()
        label = new.drop("moved")
        if not moved:
            break
    named = scratch.write(nodes.join(label.withColumnRenamed("v", "h"), "h").select("id", "root"), "named")
    groups = scratch.write(named.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("cnt")), "groups")
    out = join_unique(named, groups.select("root", "group_id"), "root", hot_keys(groups, "root"))
    scratch.drop(state, edges, nodes)
    scratch.release()
    return out.select("group_id", F.col("id").alias("record_id"))


def link_edges(decisions: DataFrame, fused: DataFrame) -> DataFrame:
    """Edges (src, dst) of positive verdicts and of the member lists of fused records.

    A list of n members gives n-1 edges from its first non-null member, not all pairs.
    """
    yes = decisions.filter("should_link AND id1 IS NOT NULL AND id2 IS NOT NULL").select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    members = fused.select(F.filter("original_ids", lambda x: x.isNotNull()).alias("ids")).filter(F.size("ids") > 1)
    star = members.select(F.element_at("ids", 1).alias("src"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("dst"))
    return yes.unionByName(star)
