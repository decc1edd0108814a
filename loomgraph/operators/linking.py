"""Entity groups, verdicts and graph fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .graph import MENTIONS, first_by, shortest_text

# Entity types in order of preference; any other ranks with MISC.
TYPE_ORDER = ["PERSON", "ORGANIZATION", "LOCATION", "DATE", "NUMBER", "MISC"]


def leader_groups(covers: DataFrame) -> DataFrame:
    """Greedy leader clustering as a fixpoint: rows (leader, member).

    ``covers`` has leader, member: the filtered neighbour list of each node. In node order an unprocessed
    node with a list becomes a leader and its members are processed. Set-wise: a node is no leader if an
    earlier leader covers it, and is one if all earlier nodes that cover it are known to be none. Every round
    decides at least the smallest open node; groups then use the whole list of each leader.
    """
    scratch = Scratch(covers.sparkSession, "leaders")
    covers = scratch.write(covers.select("leader", "member").filter("leader <> member").distinct(), "covers")
    state = scratch.write(covers.select(F.col("leader").alias("node")).distinct().withColumn("is_leader", F.lit(None).cast("boolean")), "state")
    earlier = covers.filter("leader < member")
    while True:
        by = earlier.join(state.select(F.col("node").alias("leader"), F.col("is_leader").alias("by_leader")), "leader")
        seen = by.groupBy(F.col("member").alias("node")).agg(F.max(F.coalesce("by_leader", F.lit(False))).alias("covered"), F.count_if(F.col("by_leader").isNull()).alias("open"))
        decided = F.when(F.col("is_leader").isNotNull(), F.col("is_leader")).when(F.coalesce("covered", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        new = scratch.write(state.join(seen, "node", "left").select("node", decided.alias("is_leader")), "state")
        scratch.drop(state)
        state = new
        if not state.filter("is_leader IS NULL").limit(1).count():
            break
    return covers.join(state.filter("is_leader").select(F.col("node").alias("leader")), "leader", "left_semi")


def exploded_groups(groups: DataFrame) -> DataFrame:
    """(group_id, id, text, type, similarity) of distinct groups' parallel lists."""
    g = groups.groupBy("group_id").agg(F.first("entity_ids").alias("i"), F.first("entity_texts").alias("t"), F.first("entity_types").alias("y"), F.first("similarities").alias("s"))
    z = g.select("group_id", F.explode(F.arrays_zip(F.col("i"), F.col("t"), F.col("y"), F.col("s"))).alias("m"))
    return z.select("group_id", F.col("m.i").alias("id"), F.col("m.t").alias("text"), F.col("m.y").alias("type"), F.col("m.s").alias("similarity")).filter("id IS NOT NULL")


def split_groups(members: DataFrame, chunk: int = 20) -> DataFrame:
    """(group_id, kind, part, n): groups of one text and type fuse at once, others go to a judge in chunks."""
    same = members.groupBy("group_id").agg((F.count_distinct(F.coalesce("text", F.lit("")), F.coalesce("type", F.lit(""))) == 1).alias("same"))
    rn = F.row_number().over(Window.partitionBy("group_id").orderBy(F.coalesce("similarity", F.lit(-1.0)).desc(), "id"))
    rows = members.withColumn("rn", rn).join(same, "group_id")
    part = F.when(F.col("same"), F.lit(0)).otherwise(F.floor((F.col("rn") - 1) / chunk)).cast("int")
    return rows.groupBy("group_id", F.when(F.col("same"), "auto").otherwise("judge").alias("kind"), part.alias("part")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def valid_fusions(fused: DataFrame, members: DataFrame) -> DataFrame:
    """(fused_id, group_id, id): original ids that belong to the group, of records with two or more."""
    ids = fused.select("fused_id", "group_id", F.explode("original_ids").alias("id")).filter("id IS NOT NULL").distinct()
    inside = ids.join(members.select("group_id", "id").distinct(), ["group_id", "id"], "left_semi")
    return inside.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("fused_id"))).filter("n > 1").select("fused_id", "group_id", "id")


def fusion_map(valid: DataFrame) -> DataFrame:
    """(id, fused_id): a node in several records goes with the last one."""
    return valid.groupBy("id").agg(F.max("fused_id").alias("fused_id"))


def global_entities(valid: DataFrame, mentions: DataFrame) -> DataFrame:
    """(global_id, text, entity_type, member_count, n_docs): shortest text, preferred type, documents."""
    ent = first_by(mentions.select("entity_id", "text", "type", "doc_id", "seen_at"), ["entity_id"], [F.col("seen_at"), F.coalesce("text", F.lit(""))])
    m = valid.join(ent.select(F.col("entity_id").alias("id"), "text", "type", "doc_id"), "id")
    rank = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(TYPE_ORDER)], F.lit(len(TYPE_ORDER) - 1))
    agg = m.groupBy("fused_id").agg(shortest_text("text").alias("text"), F.min(rank).alias("r"), F.count_distinct("id").alias("member_count"), F.count_distinct("doc_id").alias("n_docs"), F.min("id").alias("first"))
    return agg.select(F.concat("first", F.lit("_fused_"), "fused_id").alias("global_id"), "fused_id", "text", F.element_at(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("r") + 1).alias("entity_type"), "member_count", "n_docs")


def redirect_edges(edges: DataFrame, mapping: DataFrame, globals_: DataFrame) -> DataFrame:
    """Mention edges with fused entities in place of their members; equal edges fall together."""
    to = mapping.join(globals_.select("fused_id", "global_id"), "fused_id").select("id", "global_id")
    m = edges.filter(F.col("edge_type") == MENTIONS)
    m = m.join(to.withColumnRenamed("id", "src").withColumnRenamed("global_id", "gs"), "src", "left").join(to.withColumnRenamed("id", "dst").withColumnRenamed("global_id", "gd"), "dst", "left")
    return m.select(F.coalesce("gs", "src").alias("src"), F.coalesce("gd", "dst").alias("dst")).distinct()


def fused_nodes(nodes: DataFrame, mapping: DataFrame, globals_: DataFrame) -> DataFrame:
    """Nodes after fusion: members go, fused entities come."""
    kept = nodes.join(mapping.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("node_id", "node_type", "text")
    return kept.unionByName(globals_.select(F.col("global_id").alias("node_id"), F.lit("global_entity").alias("node_type"), "text"))


def packed_groups(members: DataFrame, chunk: int = 20) -> DataFrame:
    """(group_id, kind, part, entities): the groups of ``split_groups`` with their members, at most ``chunk`` of them.

    Groups of one text and type, of any size, are packed in chunks of their own as well; ``auto`` ones of several
    chunks are one group all the same (see ``auto_fusions``).
    """
    same = members.groupBy("group_id").agg((F.count_distinct(F.coalesce("text", F.lit("")), F.coalesce("type", F.lit(""))) == 1).alias("same"))
    rn = F.row_number().over(Window.partitionBy("group_id").orderBy(F.coalesce("similarity", F.lit(-1.0)).desc(), "id"))
    rows = members.withColumn("rn", rn).join(same, "group_id").withColumn("part", F.floor((F.col("rn") - 1) / chunk).cast("int"))
    packed = rows.groupBy("group_id", F.when(F.col("same"), "auto").otherwise("judge").alias("kind"), "part").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "text", "type", "similarity"))).alias("entities"))
    return packed.filter("size(entities) > 1")


def auto_fusions(members: DataFrame) -> DataFrame:
    """(group_id, id, text, type, confidence): groups whose members all have one text and type fuse without a judge."""
    same = members.groupBy("group_id").agg(F.count_distinct(F.coalesce("text", F.lit("")), F.coalesce("type", F.lit(""))).alias("forms"), F.count_distinct("id").alias("n"))
    return members.join(same.filter("forms = 1 AND n > 1").select("group_id"), "group_id", "left_semi").select("group_id", "id", "text", "type", F.lit(1.0).alias("confidence")).distinct()


def judged_fusions(groups: DataFrame, replies: DataFrame) -> DataFrame:
    """(group_id, part, fused, id): the sets a judge's replies make of packed groups; ids that are not in the group, sets
    of fewer than two, and replies that do not parse fuse nothing. ``replies`` has group_id, part and reply."""
    from ..functions.replies import json_text

    v = F.from_json(json_text("reply", "fused_entities"), "fused_entities array<struct<original_ids:array<string>>>")
    told = replies.select("group_id", "part", F.posexplode(v["fused_entities"]).alias("fused", "f")).select("group_id", "part", "fused", F.explode("f.original_ids").alias("id")).distinct()
    inside = groups.select("group_id", "part", F.explode("entities.id").alias("id"))
    met = told.join(inside, ["group_id", "part", "id"], "left_semi")
    several = met.groupBy("group_id", "part", "fused").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return met.join(several, ["group_id", "part", "fused"], "left_semi").select("group_id", "part", "fused", "id")


def fused_documents(valid: DataFrame, mentions: DataFrame) -> DataFrame:
    """(fused_id, doc_id): the documents of the members of each fused entity, a row each."""
    docs = mentions.select(F.col("entity_id").alias("id"), "doc_id").distinct()
    return valid.join(docs, "id").select("fused_id", "doc_id").distinct()


def fuse(nodes: DataFrame, edges: DataFrame, fused: DataFrame, members: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole fusion: nodes (node_id, node_type, text, member_count) and edges (src, dst, edge_type) of the graph after it.

    Members of valid fusions leave, fused entities come, their mention edges move over and fall together; edges
    between propositions stay.
    """
    valid = valid_fusions(fused, members)
    mapping, made = fusion_map(valid), global_entities(valid, mentions)
    kept = nodes.join(mapping.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("node_id", "node_type", "text", F.lit(None).cast("long").alias("member_count"))
    after = kept.unionByName(made.select(F.col("global_id").alias("node_id"), F.lit("global_entity").alias("node_type"), "text", "member_count"))
    moved = redirect_edges(edges, mapping, made).withColumn("edge_type", F.lit(MENTIONS))
    return after, moved.unionByName(edges.filter(F.col("edge_type") != MENTIONS).select("src", "dst", "edge_type"))


def generate_candidates(propositions: DataFrame, entities: DataFrame, k: int = 100, threshold: float = 0.85, entity_k: int = 20, entity_threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """From vectors to candidates: unordered cross-document pairs of propositions, and entity groups (leader, member).

    ``propositions`` and ``entities`` have node_id, doc_id and vec; ``propositions`` and ``entities`` may carry a column
    ``asked`` that says which rows are queries (all by default).
    """
    from .knn import neighbour_pairs, unordered_pairs

    pairs = neighbour_pairs(propositions, k, threshold)
    lists = neighbour_pairs(entities, entity_k, entity_threshold)
    return unordered_pairs(pairs.select("id1", "id2", "similarity"), [-F.col("similarity"), F.col("id1")]), leader_groups(lists.select(F.col("id1").alias("leader"), F.col("id2").alias("member")))
