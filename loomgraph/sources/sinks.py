"""Graph, index and result tables written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lookup as L


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",)) -> None:
    """Nodes by kind and edges by type as parquet, JSON lines, or both."""
    for name, df, by in (("nodes", nodes, "node_type"), ("edges", edges, "edge_type")):
        for f in formats:
            w = df.write.mode("overwrite")
            (w.partitionBy(by).parquet if f == "parquet" else w.json)(f"{path}/{name}.{f}")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")


def export_meta(propositions: DataFrame, mentions: DataFrame, relations: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Propositions, first mentions, relations and statistics as JSON lines."""
    first = G.first_by(mentions, ["doc_id", "text"], [F.col("seen_at"), F.coalesce("type", F.lit(""))])
    for name, df in (("propositions", propositions), ("entities", first), ("relations", relations), ("statistics", G.statistics(nodes, edges))):
        df.write.mode("overwrite").json(f"{path}/{name}")


def upgrade_graph(spark, source: str, target: str) -> None:
    """A stored graph written again with its missing reverse edges."""
    nodes, edges = load_graph(spark, source)
    save_graph(nodes, edges.unionByName(G.repair_reverse(edges)), target)


def save_index(vectors: DataFrame, path: str, dim: int) -> None:
    """A vector index: the vectors, and beside them one row that says their length."""
    vectors.write.mode("overwrite").parquet(path)
    vectors.sparkSession.range(1).select(F.lit(dim).alias("dim")).write.mode("overwrite").json(f"{path}.meta")


def save_store(indexes: dict[str, DataFrame], path: str) -> None:
    """Several vector tables in one, partitioned by the name of the index."""
    named = [df.withColumn("index_name", F.lit(name)) for name, df in indexes.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    out.write.mode("overwrite").partitionBy("index_name").parquet(path)


def save_candidates(auto: DataFrame, judged: DataFrame, pairs: DataFrame, path: str) -> None:
    """What linking works on: groups that fuse at once, groups for the judge, and pairs."""
    for name, df in (("auto_groups", auto), ("judge_groups", judged), ("pairs", pairs)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def persist_artefacts(nodes: DataFrame, edges: DataFrame, documents: DataFrame, path: str, globals_: DataFrame | None = None, vectors: DataFrame | None = None, names: DataFrame | None = None) -> list[str]:
    """One table per artefact that retrieval reads; returns their names.

    ``globals_`` are fused entities, ``vectors`` (node_id, vec) those of the nodes and ``names`` (name, vec) those of entity
    names. Mappings and lookups are rows, so no key's members need fit one row. Derived tables are made from
    the adjacency as it was written, which is read back.
    """
    spark = nodes.sparkSession
    G.adjacency(nodes, edges).write.mode("overwrite").parquet(f"{path}/adjacency")
    adjacency = spark.read.parquet(f"{path}/adjacency")
    degrees = G.entity_degree(nodes, adjacency.select(F.col("node_id").alias("src"), "edge_type"))
    named = nodes.filter("node_type <> 'proposition'").select("node_id", "node_type", "text", F.lit(0).cast("long").alias("member_count"))
    if globals_ is not None:
        named = named.unionByName(globals_.select(F.col("global_id").alias("node_id"), F.lit("global_entity").alias("node_type"), "text", F.col("member_count").cast("long").alias("member_count")))
    tables = {
        "entity_degree": degrees,
        "global_statistics": G.global_statistics(degrees),
        "node_mappings": L.mapping_rows(nodes),
        "document_metadata": G.document_metadata(nodes, documents),
        "entity_lookup": L.lookup_rows(named),
        "entity_aliases": G.entity_aliases(nodes),
        "predecessors": adjacency.filter((F.col("edge_type") == G.MENTIONS) & (F.col("neighbour_type") == "proposition")).select(F.col("node_id").alias("entity"), F.col("neighbour").alias("node_id")).distinct(),
    }
    if vectors is not None:
        tables["node_vectors"] = vectors
    if names is not None:
        tables["entity_names"] = names
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return ["adjacency", *tables]


def save_evaluation(details: DataFrame, summary: DataFrame, path: str) -> None:
    """Scores of all answers and their summary, as JSON lines."""
    details.write.mode("overwrite").json(f"{path}/details")
    summary.write.mode("overwrite").json(f"{path}/summary")


def save_results(answers: DataFrame, path: str) -> None:
    answers.write.mode("overwrite").json(path)
