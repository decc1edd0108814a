"""Names, signatures, positions and vectors looked up by joins; every result holds all members as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import EmbeddingModel, embed_distinct
from ..session import Scratch
from .skew import numbered


def lookup_rows(nodes: DataFrame) -> DataFrame:
    """(name, kind, place, node_id): all nodes of each lower-case name. Fused entities come first, by member count;
    a node's place is its rank among the nodes of its name and kind.

    ``nodes`` has node_id, node_type (entity or global_entity), text and member_count.
    """
    named = nodes.filter(F.col("node_type").isin("entity", "global_entity")).withColumn("name", F.lower(F.trim("text"))).filter("name <> ''")
    rows = named.select("name", F.col("node_type").alias("kind"), F.coalesce("member_count", F.lit(0)).alias("_m"), "node_id")
    placed = numbered(rows, ["name", "kind"], [F.col("_m").desc(), F.col("node_id")], "place", Scratch(nodes.sparkSession, "lookup"))
    return placed.select("name", "kind", "place", "node_id")


def best_nodes(nodes: DataFrame, prefer_global: bool = True) -> DataFrame:
    """(name, node_id): one node of each name, the fused one of most members first (or last); a partially
    aggregated minimum, so no name is ever sorted whole."""
    named = nodes.filter(F.col("node_type").isin("entity", "global_entity")).withColumn("name", F.lower(F.trim("text"))).filter("name <> ''")
    fused = (F.col("node_type") == "global_entity") == F.lit(prefer_global)
    return named.groupBy("name").agg(F.min(F.struct((~fused).alias("late"), (-F.coalesce("member_count", F.lit(0))).alias("few"), "node_id")).alias("b")).select("name", "b.node_id")


def lookup_names(names: DataFrame, best: DataFrame, how: str = "left") -> DataFrame:
    """``names`` with the node of each; ``left`` keeps unknown names with null, ``inner`` drops them."""
    return names.withColumn("_n", F.lower(F.trim("name"))).join(best.withColumnRenamed("name", "_n"), "_n", how).drop("_n")


def lookup_statistics(nodes: DataFrame) -> DataFrame:
    """(kind, names, nodes): distinct names and nodes of each kind."""
    named = nodes.filter(F.col("node_type").isin("entity", "global_entity")).withColumn("name", F.lower(F.trim("text"))).filter("name <> ''")
    return named.groupBy(F.col("node_type").alias("kind")).agg(F.count_distinct("name").alias("names"), F.count(F.lit(1)).alias("nodes"))


def mapping_rows(nodes: DataFrame) -> DataFrame:
    """(mapping, key, member): propositions to documents and back, entities to documents and back, every member a row."""
    pair = lambda kind, name, key, member: nodes.filter(f"node_type = '{kind}'").select(F.lit(name).alias("mapping"), F.col(key).alias("key"), F.col(member).alias("member"))
    both = pair("proposition", "proposition_doc", "node_id", "doc_id").unionByName(pair("proposition", "doc_propositions", "doc_id", "node_id"))
    return both.unionByName(pair("entity", "entity_docs", "node_id", "doc_id")).unionByName(pair("entity", "doc_entities", "doc_id", "node_id")).distinct()


def same_signature(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, node_id): nodes with the document, text and type of a member of a group, the members included."""
    sign = nodes.filter("node_type = 'entity'").select("node_id", "doc_id", "text", F.coalesce("entity_type", F.lit("")).alias("type"))
    wanted = members.select("group_id", "doc_id", "text", F.coalesce("type", F.lit("")).alias("type")).distinct()
    return wanted.join(sign, ["doc_id", "text", "type"]).select("group_id", "node_id").unionByName(members.select("group_id", F.col("id").alias("node_id"))).distinct()


def listed_documents(lists: DataFrame, documents: DataFrame, key: str, items: str, doc: str) -> DataFrame:
    """(key, place, doc): the listed documents that exist, in the order of the list."""
    each = lists.select(key, F.posexplode(items).alias("place", doc))
    return each.join(documents.select(doc).distinct(), doc, "left_semi").select(key, "place", doc)


def missing_titles(with_propositions: DataFrame, with_entities: DataFrame, titled: DataFrame) -> DataFrame:
    """Documents to look a title up for: all with propositions, and those with entities that have no title yet."""
    return with_propositions.select("doc_id").unionByName(with_entities.select("doc_id").join(titled.select("doc_id"), "doc_id", "left_anti")).distinct()


def titles_by_position(ids: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, title): the title at the position an id names (``hotpot_7``), without empty ones."""
    from .evaluation import doc_number

    numbered = ids.select("doc_id", doc_number("doc_id").alias("pos")).filter("pos IS NOT NULL")
    return numbered.join(titles.select("pos", "title").filter("title IS NOT NULL AND title <> ''"), "pos").select("doc_id", "title")


def vectors_of(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label, vec): the stored vector of each label, null where there is none. ``vectors`` has node_id and vec."""
    return labels.select("label").distinct().join(vectors.select(F.col("node_id").alias("label"), "vec"), "label", "left")


def add_vectors(index: DataFrame, items: DataFrame) -> DataFrame:
    """The index with the items added; an item replaces the vector of its label."""
    return index.join(items.select("node_id"), "node_id", "left_anti").unionByName(items)


def name_index(nodes: DataFrame, model: Callable[[], EmbeddingModel]) -> DataFrame:
    """(name, vec): trimmed names of entity nodes, every distinct one embedded once."""
    names = nodes.filter("node_type <> 'proposition'").select(F.trim("text").alias("name")).filter("name <> ''")
    return embed_distinct(names, "name", model)


def node_index(nodes: DataFrame, model: Callable[[], EmbeddingModel]) -> DataFrame:
    """(node_id, node_type, vec) of all nodes with a text; equal texts are embedded once."""
    texts = nodes.filter("trim(coalesce(text, '')) <> ''").select("node_id", "node_type", "text")
    return texts.join(embed_distinct(texts, "text", model), "text").select("node_id", "node_type", "vec")


def embedded(texts: DataFrame, cache: DataFrame, model: Callable[[], EmbeddingModel], dim: int) -> DataFrame:
    """(key, text, hit, vec) of all distinct texts: from the cache, else from the model, else zeros.

    ``cache`` has key, the MD5 of a whole text, and vec. Only misses reach the model, each distinct text once; a vector
    that is null or of another length becomes zeros. New rows are added to the cache by writing those with hit false.
    """
    keyed = texts.select("text").filter("text IS NOT NULL").distinct().withColumn("key", F.md5("text"))
    known = keyed.join(cache.select("key", "vec"), "key").select("key", "text", F.lit(True).alias("hit"), "vec")
    missed = keyed.join(cache.select("key"), "key", "left_anti")
    made = missed.join(embed_distinct(missed, "text", model), "text", "left").select("key", "text", F.lit(False).alias("hit"), "vec")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return known.unionByName(made).select("key", "text", "hit", F.when(F.size("vec") == dim, F.col("vec")).otherwise(zeros).alias("vec"))


def cache_statistics(embedded_texts: DataFrame) -> DataFrame:
    """(texts, hits, hit_rate) of what ``embedded`` gives."""
    return embedded_texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if("hit").alias("hits"), F.round(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)), 6).alias("hit_rate"))
