"""Nearest-neighbour joins of stated queries against all vectors, and pair clean-up."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.vector import cosine, norm

#: Bytes of query vectors broadcast at once; more queries are met in blocks.
BLOCK_BYTES = 64 << 20


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array([v if v is not None and len(v) == dim else np.zeros(dim) for v in vectors], dtype=np.float64).reshape(-1, dim)


def _nearest(queries: np.ndarray, items: DataFrame, k: int, dim: int, places: int) -> DataFrame:
    """(q, item_id, similarity): per batch of items the k best of each query, ties by item."""
    norms = np.sqrt((queries * queries).sum(axis=1))
    shared = items.sparkSession.sparkContext.broadcast((queries, norms))

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, qn = shared.value
        for batch in batches:
            batch = batch.sort_values("item_id", ignore_index=True)  # equal values keep the order of the items
            m = _matrix(batch["vec"], dim)
            mn = np.sqrt((m * m).sum(axis=1))
            ids = batch["item_id"].to_numpy()
            for at in range(0, len(q), 512):
                scale = qn[at : at + 512, None] * mn[None, :]
                sims = np.divide(q[at : at + 512] @ m.T, scale, out=np.zeros_like(scale), where=scale != 0)
                sims = np.round(sims, places)
                n = min(k, len(ids))
                least = np.partition(sims, len(ids) - n, axis=1)[:, len(ids) - n]
                row, col = np.nonzero(sims >= least[:, None])
                order = np.lexsort((col, -sims[row, col], row))
                row, col = row[order], col[order]
                best = np.arange(len(row)) - np.searchsorted(row, row, "left") < n
                row, col = row[best], col[best]
                yield pd.DataFrame({"q": row + at, "item_id": ids[col], "similarity": sims[row, col]})

    item_type = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "vec").filter("vec IS NOT NULL AND item_id IS NOT NULL").mapInPandas(against, f"q long, item_id {item_type}, similarity double")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, places: int = 6) -> DataFrame:
    """(query_id, item_id, similarity, item_rank): the k most similar vectors of each query, exactly.

    ``queries`` has query_id and vec, ``vectors`` item_id and vec. The queries are a stated set that is brought to
    the driver and broadcast as one matrix, in blocks of at most BLOCK_BYTES; the vectors are scanned once per block, a batch
    at a time as a matrix product, and never shuffled: a batch gives its k best rows of each query, of
    which a row number pushed below the exchange keeps k a task. The threshold comes after the k, as in an index search.

    Defined cases: ties go to the smaller item; a vector without length, or of another length than the queries', has
    similarity 0; null vectors and ids take no part; no queries or no vectors, empty result.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", "vec").filter("vec IS NOT NULL AND query_id IS NOT NULL").collect()
    dim = max((len(r["vec"]) for r in asked), default=1)
    step = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    parts = [_nearest(_matrix(pd.Series([r["vec"] for r in asked[at : at + step]], dtype=object), dim), vectors, k, dim, places).withColumn("q", F.col("q") + at) for at in range(0, max(1, len(asked)), step)]
    names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], StructType([StructField("q", LongType()), queries.schema["query_id"]]))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("similarity").desc(), "item_id"))
    top = reduce(DataFrame.unionByName, parts).withColumn("item_rank", rank).filter(F.col("item_rank") <= k)
    named = top.join(F.broadcast(names), "q").select("query_id", "item_id", F.round("similarity", places).alias("similarity"), "item_rank")
    return named if threshold is None else named.filter(F.col("similarity") >= threshold)


def neighbour_pairs(nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (id1, id2, doc_id1, doc_id2, similarity): of the k nearest nodes of each asked node, itself included, those of
    another document with at least the threshold; the k comes first, as a list has k entries before it is filtered.

    ``nodes`` has node_id, doc_id and vec, and perhaps ``asked`` (boolean): only such nodes are queries. Every node
    is searched. Without ``asked`` this is a search of all against all, in blocks; ``lsh_join`` does large ones.
    """
    asked = nodes.filter("asked") if "asked" in nodes.columns else nodes
    near = knn_join(asked.select(F.col("node_id").alias("query_id"), "vec"), nodes.select(F.col("node_id").alias("item_id"), "vec"), k)
    doc = nodes.select("node_id", "doc_id")
    met = near.filter((F.col("query_id") != F.col("item_id")) & (F.col("similarity") >= threshold))
    met = met.join(doc.select(F.col("node_id").alias("query_id"), F.col("doc_id").alias("doc_id1")), "query_id").join(doc.select(F.col("node_id").alias("item_id"), F.col("doc_id").alias("doc_id2")), "item_id")
    return met.filter("doc_id1 <> doc_id2").select(F.col("query_id").alias("id1"), F.col("item_id").alias("id2"), "doc_id1", "doc_id2", "similarity")


def lsh_join(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 12, width: float = 1.0, threshold: float = 0.3) -> DataFrame:
    """Approximate ``knn_join`` for many queries: random projections of unit vectors, then the exact cosine.

    On unit vectors the squared distance is 2 - 2 cos, so a similarity threshold is a distance threshold.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = lambda df, key: df.filter(norm(F.col("vec")) > 0).select(key, "vec", array_to_vector(F.transform(F.col("vec").cast("array<double>"), lambda x: x / norm(F.col("vec")))).alias("unit"))
    items = unit(vectors, "item_id")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=7).fit(items.limit(1))
    near = model.approxSimilarityJoin(unit(queries, "query_id"), items, (2 - 2 * threshold) ** 0.5, distCol="dist")
    scored = near.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.item_id").alias("item_id"), F.round(cosine(F.col("datasetA.vec"), F.col("datasetB.vec")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id"))
    return scored.withColumn("item_rank", rank).filter(F.col("item_rank") <= k)


def candidate_pairs(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of neighbour lists (id1, id2, doc_id1, doc_id2, similarity): the first k, then other node, other
    document and at least the threshold; the k comes first, as a list has k entries before it is filtered."""
    usable = lists.filter("similarity IS NOT NULL AND NOT isnan(similarity)").groupBy("id1", "id2", "doc_id1", "doc_id2").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id1").orderBy(F.col("similarity").desc(), "id2"))
    top = usable.withColumn("k", rank).filter(F.col("k") <= k)
    return top.filter((F.col("id1") != F.col("id2")) & (F.col("doc_id1") != F.col("doc_id2")) & (F.col("similarity") >= threshold)).drop("k")


def unordered_pairs(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """One row per unordered pair, the first in the order; no pair's rows are sorted whole."""
    keep = [c for c in pairs.columns if c not in ("id1", "id2")]
    return pairs.groupBy(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], "id1", "id2", *keep)).alias("r")).select("r.id1", "r.id2", *[F.col(f"r.{c}").alias(c) for c in keep])
