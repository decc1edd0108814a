"""The proposition graph as two DataFrames: build, repair, statistics and derived artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import direction, edge_type

MENTIONS = "MENTIONS_ENTITY"


def first_by(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key, the first in the order: a partially aggregated minimum, so no key is ever sorted whole."""
    cols = [c for c in df.columns if c not in keys]
    pick = (F.max if last else F.min)(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in cols]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def nodes(propositions: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Proposition and entity nodes. A text's first mention in a document fixes its type; ids are upserts."""
    titles = documents.select(F.col("doc_key").alias("doc_id"), "title")
    props = first_by(propositions.select("node_id", "doc_id", "text", "sent_idx", "prop_idx"), ["node_id"], [F.col("prop_idx")])
    props = props.join(titles, "doc_id", "left").select("node_id", F.lit("proposition").alias("node_type"), "text", "doc_id", F.coalesce("title", F.lit("")).alias("title"), "sent_idx", "prop_idx", F.lit(None).cast("string").alias("entity_type"))
    ents = first_by(mentions.select("entity_id", "doc_id", "text", "type", "seen_at"), ["doc_id", "text"], [F.col("seen_at"), F.coalesce("type", F.lit(""))])
    ents = first_by(ents, ["entity_id"], [F.col("seen_at"), F.col("text")], last=True)
    ents = ents.select(F.col("entity_id").alias("node_id"), F.lit("entity").alias("node_type"), "text", "doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("sent_idx"), F.lit(None).cast("int").alias("prop_idx"), F.col("type").alias("entity_type"))
    return props.unionByName(ents)


def mention_edges(mentions: DataFrame, propositions: DataFrame) -> DataFrame:
    """Two directed edges between each entity and the proposition that names it, where that exists."""
    ids = propositions.select("doc_id", "prop_idx", F.col("node_id").alias("p")).distinct()
    met = mentions.filter("prop_idx IS NOT NULL").select("doc_id", "prop_idx", F.col("entity_id").alias("e")).distinct().join(ids, ["doc_id", "prop_idx"])
    both = met.select(F.explode(F.array(F.struct(F.col("p").alias("src"), F.col("e").alias("dst")), F.struct(F.col("e").alias("src"), F.col("p").alias("dst")))).alias("x"))
    return both.select("x.src", "x.dst", F.lit(MENTIONS).alias("edge_type"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("double").alias("confidence")).distinct()


def directed(relations: DataFrame) -> DataFrame:
    """Relations (id1, id2, edge_type, direction, ...) as directed edges: similar ones and ``1<->2`` both ways."""
    both = (F.col("edge_type") == "SIMILARITY") | (F.col("direction") == "1<->2")
    forward, back = F.struct(F.col("id1").alias("src"), F.col("id2").alias("dst")), F.struct(F.col("id2").alias("src"), F.col("id1").alias("dst"))
    ways = F.when(both, F.array(forward, back)).when(F.col("direction") == "2->1", F.array(back)).otherwise(F.array(forward))
    return relations.select(F.explode(ways).alias("w"), *[c for c in relations.columns if c not in ("id1", "id2")]).select("w.src", "w.dst", *[c for c in relations.columns if c not in ("id1", "id2")])


def relation_edges(decisions: DataFrame, propositions: DataFrame) -> DataFrame:
    """Edges of positive verdicts between propositions; a later verdict on a pair overwrites an earlier one."""
    ids = propositions.select(F.col("node_id").alias("id")).distinct()
    yes = decisions.filter("should_link AND relation_type IS NOT NULL AND id1 <> id2").select("id1", "id2", edge_type("relation_type").alias("edge_type"), direction("direction").alias("direction"), "confidence", "decided_at", "decision_id")
    yes = yes.join(ids.withColumnRenamed("id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("id", "id2"), "id2", "left_semi")
    last = first_by(directed(yes), ["src", "dst"], [F.col("decided_at"), F.col("decision_id")], last=True)
    return last.select("src", "dst", "edge_type", "direction", "confidence")


def edges(mentions: DataFrame, decisions: DataFrame, propositions: DataFrame) -> DataFrame:
    return mention_edges(mentions, propositions).unionByName(relation_edges(decisions, propositions))


def repair_reverse(edges: DataFrame) -> DataFrame:
    """Missing reverse edges of similar, mention and two-way edges, as a set operation."""
    need = edges.filter((F.col("edge_type").isin("SIMILARITY", MENTIONS)) | (F.col("direction") == "1<->2"))
    reverse = need.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "direction", "confidence")
    return reverse.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return nodes.join(ends, "node_id", "left_anti").select("node_id", "node_type")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): nodes and edges by type, and nodes without edges."""
    by_node = nodes.groupBy(F.concat(F.lit("nodes_"), "node_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    by_edge = edges.groupBy(F.concat(F.lit("edges_"), F.lower("edge_type")).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    alone = isolated(nodes, edges).agg(F.count(F.lit(1)).alias("value")).select(F.lit("isolated").alias("metric"), "value")
    return by_node.unionByName(by_edge).unionByName(alone)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbour rows (node_id, edge_type, neighbour, neighbour_type) with edge types in coarse form."""
    kind = nodes.select("node_id", "node_type")
    e = edges.join(kind.select(F.col("node_id").alias("dst"), F.col("node_type").alias("neighbour_type")), "dst")
    coarse = F.when(F.col("edge_type") == MENTIONS, F.col("edge_type")).otherwise(edge_type("edge_type"))
    return e.select(F.col("src").alias("node_id"), coarse.alias("edge_type"), F.col("dst").alias("neighbour"), "neighbour_type")


def entity_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): entities each proposition mentions, 0 included."""
    props = nodes.filter("node_type = 'proposition'").select("node_id")
    deg = edges.filter(F.col("edge_type") == MENTIONS).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    return props.join(deg, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def global_statistics(degrees: DataFrame) -> DataFrame:
    """(norm, median, mean, count) over propositions with entities; norm is the larger of both, 1 if none."""
    s = degrees.filter("degree > 0").agg(F.median("degree").alias("median"), F.round(F.avg("degree"), 6).alias("mean"), F.count(F.lit(1)).alias("count"))
    return s.select(F.coalesce(F.greatest("median", "mean"), F.lit(1.0)).alias("norm"), F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("mean", F.lit(0.0)).alias("mean"), "count")


def ordered_text(items: DataFrame, key: str, order: list[str], text: Column, separator: str) -> DataFrame:
    """(key, text): the texts of a document in order, joined. A document's sentences fit a row by nature."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"])
    return items.groupBy(key).agg(F.array_join(rows, separator).alias("text"))


def node_mappings(nodes: DataFrame) -> DataFrame:
    """(mapping, key, n, members): documents to propositions and entities, each with the smallest member."""
    doc = lambda kind, name: nodes.filter(f"node_type = '{kind}'").groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_member"), F.max("node_id").alias("last_member")).select(F.lit(name).alias("mapping"), "*")
    ents = nodes.filter("node_type = 'entity'").groupBy(F.col("text").alias("key")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_member"), F.max("doc_id").alias("last_member")).select(F.lit("entity_docs").alias("mapping"), "*")
    return doc("proposition", "doc_propositions").unionByName(doc("entity", "doc_entities")).unionByName(ents)


def document_metadata(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, title, proposition_count, entity_count) of documents in the graph; the id where no title is."""
    counts = nodes.filter("doc_id <> ''").groupBy("doc_id").agg(F.count_if(F.col("node_type") == "proposition").alias("proposition_count"), F.count_if(F.col("node_type") == "entity").alias("entity_count"))
    titled = counts.join(documents.select(F.col("doc_key").alias("doc_id"), F.nullif(F.trim("title"), F.lit("")).alias("title")), "doc_id", "left")
    return titled.select("doc_id", F.coalesce("title", "doc_id").alias("title"), "proposition_count", "entity_count")


def entity_lookup(nodes: DataFrame) -> DataFrame:
    """(name, n_nodes, n_docs, first_node): entity nodes by lower-case name."""
    e = nodes.filter("node_type = 'entity'").withColumn("name", F.lower(F.trim("text"))).filter("name <> ''")
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("doc_id").alias("n_docs"), F.min("node_id").alias("first_node"))


def entity_aliases(nodes: DataFrame) -> DataFrame:
    """(alias, node_id): full name, last and first word; the first writer of an alias keeps it."""
    e = nodes.filter("node_type = 'entity'").withColumn("name", F.lower(F.trim("text"))).filter("name <> ''").withColumn("w", F.split("name", r"\s+"))
    alias = e.select("node_id", F.posexplode(F.array("name", F.element_at("w", -1), F.element_at("w", 1))).alias("place", "alias"))
    return alias.groupBy("alias").agg(F.min_by("node_id", F.struct("place", "node_id")).alias("node_id"))


def name_lookup(names: DataFrame, lookup: DataFrame, how: str = "left") -> DataFrame:
    """Case-insensitive name to node; ``how`` left keeps unknown names."""
    return names.withColumn("name", F.lower(F.trim("name"))).join(lookup, "name", how)


def shortest_text(c: str) -> Column:
    return F.min_by(c, F.struct(F.length(c), F.col(c)))


def window_rank(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
