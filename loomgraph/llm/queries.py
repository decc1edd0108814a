"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .components import hash_to_min, link_edges
from .defects import defective_pairs
from .knn import similar_pairs
from .leakage import leak_report, leaked_items
from .neardup import near_duplicates
from .packing import pack, pack_report, token_counts
from .spellings import link_spellings
from .survivor import survivorship
from .topn import top_n
from .truncation import truncated, truncation_report


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hash_to_min(link_edges(read_table(spark, d, "linking_decisions"), read_table(spark, d, "fused_entities")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(read_table(spark, d, "candidate_pairs"), "id1", "id2", "similarity", 10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    props = read_table(spark, d, "propositions").select(F.lit("prop").alias("kind"), F.col("prop_id").alias("id"), "text")
    return near_duplicates(docs.unionByName(props))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    named = read_table(spark, d, "entities").select("text").unionByName(read_table(spark, d, "fused_entities").select(F.col("fused_text").alias("text")))
    return link_spellings(named)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship(read_table(spark, d, "fused_entities"), read_table(spark, d, "entity_candidate_groups"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(read_table(spark, d, "embedding_responses"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "test_questions").select("question_id", F.array("passage", "question").alias("texts"))
    return leaked_items(read_table(spark, d, "documents"), items)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(p9_found(spark, d), read_table(spark, d, "test_questions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return defective_pairs(read_table(spark, d, "answer_results"), read_table(spark, d, "test_questions"), read_table(spark, d, "documents"))


def p8_contexts(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(read_table(spark, d, "documents")))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(p8_contexts(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(read_table(spark, d, "documents")).select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return truncation_report(docs, truncated(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_contexts": p8_contexts,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_sources": p10_sources,
}

# Fixed values shared by the SQL: texts that name nothing.
_NO_NAME = "'', '-', '--', '?', '??', '...', '…', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'tba', 'todo', 'unknown', 'not given', 'not available', 'not specified', 'unspecified', 'undefined', 'missing', 'empty', 'placeholder', 'xxx'"

# Every run of twelve words of the items, met in the documents.
_LEAKS = r"""
    item AS (SELECT question_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w
             FROM (SELECT question_id, unnest([passage, question]) AS t FROM test_questions) WHERE question_id IS NOT NULL AND t IS NOT NULL),
    i12 AS (SELECT DISTINCT question_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT question_id, w, unnest(range(1, len(w) - 10)) AS i FROM item)),
    doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    d12 AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc)),
    leak AS (SELECT DISTINCT doc_id, question_id FROM d12 JOIN i12 USING (run))
"""

ORACLE_SQL: dict[str, str] = {
    # all pairs of vectors: the forest leaves none out where a shard holds all of them, as at small scales
    "p6_found": """
        WITH v AS (SELECT DISTINCT node_id, vec FROM (SELECT unnest(node_ids) AS node_id, unnest(embeddings) AS vec FROM embedding_responses)
                   WHERE node_id IS NOT NULL AND vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
        u AS (SELECT node_id, vec::DOUBLE[] AS d, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM v),
        s AS (SELECT a.node_id AS x, b.node_id AS y, round(list_dot_product(a.d, b.d) / (a.n * b.n), 6) AS sim FROM u a, u b WHERE a.node_id <> b.node_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS k FROM s)
        SELECT DISTINCT least(x, y) AS node_lo, greatest(x, y) AS node_hi FROM r WHERE k <= 5 AND sim >= 0.8
    """,
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, question_id FROM leak",
    "p9_report": f"WITH {_LEAKS} SELECT question_id, count(*) AS n_docs FROM leak GROUP BY question_id",
    "p1_found": """
        WITH RECURSIVE members AS (SELECT list_filter(original_ids, lambda x: x IS NOT NULL) AS ids FROM fused_entities),
        e AS (
            SELECT id1 AS a, id2 AS b FROM linking_decisions WHERE should_link AND id1 IS NOT NULL AND id2 IS NOT NULL AND id1 <> id2
            UNION SELECT ids[1], x FROM (SELECT ids, unnest(ids) AS x FROM members) WHERE ids[1] <> x
        ),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(node, reach) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach)
        SELECT min(reach) AS group_id, node AS record_id FROM r GROUP BY node
    """,
    "p2_found": """
        WITH m AS (SELECT id1, id2, max(similarity) AS s FROM candidate_pairs
                   WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND id1 <> id2 GROUP BY id1, id2),
        k AS (SELECT id1, CAST(row_number() OVER (PARTITION BY id1 ORDER BY s DESC, id2) AS INTEGER) AS item_rank, id2 FROM m)
        SELECT id1, item_rank, id2 FROM k WHERE item_rank <= 10
    """,
    "p5_found": f"""
        WITH g AS (SELECT DISTINCT group_id, entity_texts FROM entity_candidate_groups),
        occ AS (SELECT group_id, trim(t) AS name, count(*) AS n FROM (SELECT group_id, unnest(entity_texts) AS t FROM g) GROUP BY 1, 2),
        f AS (SELECT DISTINCT fused_id, group_id, trim(fused_text) AS name, upper(trim(fused_type)) AS kind, fused_at,
                     CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1 THEN -1 ELSE confidence END AS c
              FROM fused_entities WHERE group_id IS NOT NULL),
        n AS (SELECT f.group_id, f.fused_id, row_number() OVER (PARTITION BY f.group_id ORDER BY c DESC, coalesce(o.n, 0) DESC, fused_at DESC NULLS LAST, fused_id) AS k
              FROM f LEFT JOIN occ o ON o.group_id = f.group_id AND o.name = f.name
              WHERE f.name IS NOT NULL AND lower(f.name) NOT IN ({_NO_NAME}) AND NOT regexp_matches(f.name, '^[<\\[({{].*[>\\])}}]$')),
        y AS (SELECT group_id, fused_id, row_number() OVER (PARTITION BY group_id ORDER BY c DESC, fused_at DESC NULLS LAST, fused_id) AS k
              FROM f WHERE kind IN ('PERSON', 'ORGANIZATION', 'LOCATION', 'WORK_OF_ART', 'EVENT', 'DATE', 'CUSTOM'))
        SELECT a.group_id, coalesce(n.fused_id, 0) AS text_from, coalesce(y.fused_id, 0) AS type_from
        FROM (SELECT DISTINCT group_id FROM f) a LEFT JOIN n ON n.group_id = a.group_id AND n.k = 1 LEFT JOIN y ON y.group_id = a.group_id AND y.k = 1
    """,
}
