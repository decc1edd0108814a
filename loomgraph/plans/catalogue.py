"""Registered queries over the graph tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.replies import reply_field
from ..functions.vector import cosine, hashed_words
from ..operators import evaluation, graph, knn, linking, traversal
from ..session import Scratch, read_table
from ..sources.documents import load_or_compute

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Base tables without their repeated rows ------------------------------------------------------------


def _props(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "propositions").select("prop_id", "node_id", "doc_id", "prop_idx", "sent_idx", "text").distinct()


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "entities").select("entity_id", "doc_id", "prop_idx", "text", "type", "custom_type", "seen_at").distinct()


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "linking_decisions").select("decision_id", "id1", "id2", "should_link", "relation_type", "direction", "confidence", "decided_at").distinct()


def _documents(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_props(s, d), _mentions(s, d), _documents(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(_mentions(s, d), _decisions(s, d), _props(s, d))


_PROPS = "props AS (SELECT DISTINCT prop_id, node_id, doc_id, prop_idx, sent_idx, text FROM propositions)"
_MENTS = "ments AS (SELECT DISTINCT entity_id, doc_id, prop_idx, text, type, custom_type, seen_at FROM entities)"
_NODES = f"""{_PROPS}, {_MENTS},
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seen_at, coalesce(type, '')) AS k FROM ments) WHERE k = 1),
    ents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seen_at DESC, text DESC) AS j FROM firsts) WHERE j = 1),
    nodes AS (
        SELECT node_id, 'proposition' AS node_type, p.text, p.doc_id, coalesce(d.title, '') AS title, sent_idx, prop_idx, NULL AS entity_type
        FROM props p LEFT JOIN documents d ON d.doc_key = p.doc_id
        UNION ALL SELECT entity_id, 'entity', text, doc_id, NULL, NULL, NULL, type FROM ents)"""
_COARSE = "CASE WHEN {0} IN ('SEQUENCE', 'CONTRAST', 'CONCESSION', 'SKELETON') THEN 'SKELETON' WHEN {0} IN ('CAUSED_BY', 'MOTIVATION', 'ELABORATION', 'BACKGROUND', 'DETAIL') THEN 'DETAIL' ELSE 'SIMILARITY' END"
_EDGES = f"""
    met AS (SELECT DISTINCT p.node_id AS p, m.entity_id AS e FROM ments m JOIN props p ON p.doc_id = m.doc_id AND p.prop_idx = m.prop_idx),
    yes AS (SELECT DISTINCT decision_id, id1, id2, {_COARSE.format('relation_type')} AS edge_type, CASE WHEN direction IN ('1->2', '2->1', '1<->2') THEN direction ELSE '1->2' END AS direction, confidence, decided_at
            FROM linking_decisions WHERE should_link AND relation_type IS NOT NULL AND id1 <> id2 AND id1 IN (SELECT node_id FROM props) AND id2 IN (SELECT node_id FROM props)),
    dir AS (SELECT id1 AS src, id2 AS dst, * FROM yes WHERE edge_type = 'SIMILARITY' OR direction IN ('1<->2', '1->2')
            UNION ALL SELECT id2, id1, * FROM yes WHERE edge_type = 'SIMILARITY' OR direction IN ('1<->2', '2->1')),
    edges AS (
        SELECT p AS src, e AS dst, 'MENTIONS_ENTITY' AS edge_type, NULL AS direction, NULL AS confidence FROM met
        UNION ALL SELECT e, p, 'MENTIONS_ENTITY', NULL, NULL FROM met
        UNION ALL SELECT src, dst, edge_type, direction, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY decided_at DESC, decision_id DESC) AS k FROM dir) WHERE k = 1)"""
_GRAPH = f"WITH {_NODES}, {_EDGES}"

# Graph ----------------------------------------------------------------------------------------------


@query(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d)


@query(f"{_GRAPH} SELECT * FROM edges")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


@query(f"""{_GRAPH} SELECT 'nodes_' || node_type AS metric, count(*) AS value FROM nodes GROUP BY 1
    UNION ALL SELECT 'edges_' || lower(edge_type), count(*) FROM edges GROUP BY 1
    UNION ALL SELECT 'isolated', count(*) FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)""")
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    return graph.statistics(_nodes(s, d), _edges(s, d))


@query(f"{_GRAPH} SELECT node_id, node_type FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def isolated_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.isolated(_nodes(s, d), _edges(s, d))


@query(f"SELECT {_COARSE.format('relation_type')} AS edge_type, CASE WHEN direction IN ('1->2', '2->1', '1<->2') THEN direction ELSE '1->2' END AS direction, count(*) AS n FROM (SELECT DISTINCT decision_id, relation_type, direction FROM linking_decisions) GROUP BY 1, 2")
def edge_type_norm(s: SparkSession, d: str) -> DataFrame:
    return _decisions(s, d).groupBy(T.edge_type("relation_type").alias("edge_type"), T.direction("direction").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_GRAPH}, way AS (SELECT * FROM edges WHERE src < dst OR edge_type <> 'MENTIONS_ENTITY') SELECT e.dst AS src, e.src AS dst, e.edge_type, e.direction, e.confidence FROM way e
    WHERE (e.edge_type IN ('SIMILARITY', 'MENTIONS_ENTITY') OR e.direction = '1<->2') AND NOT EXISTS (SELECT 1 FROM way r WHERE r.src = e.dst AND r.dst = e.src)""")
def reverse_edge_repair(s: SparkSession, d: str) -> DataFrame:
    # a graph whose mention edges were stored one way
    return graph.repair_reverse(_edges(s, d).filter((F.col("src") < F.col("dst")) | (F.col("edge_type") != graph.MENTIONS)))


@query("""WITH p AS (SELECT DISTINCT doc_id, prop_idx, text FROM propositions)
    SELECT doc_id, string_agg('[' || prop_idx || '] ' || text, chr(10) ORDER BY prop_idx, text) AS text FROM p GROUP BY 1""")
def doc_numbered_text(s: SparkSession, d: str) -> DataFrame:
    p = _props(s, d).select("doc_id", "prop_idx", "text").distinct()
    return graph.ordered_text(p, "doc_id", ["prop_idx", "text"], F.concat(F.lit("["), F.col("prop_idx").cast("string"), F.lit("] "), "text"), "\n")


@query("""WITH p AS (SELECT DISTINCT doc_id, coalesce(sent_idx, 0) AS s, prop_idx, text FROM propositions)
    SELECT doc_id, string_agg('[' || s || '] ' || text, chr(10) ORDER BY s, prop_idx, text) AS text FROM p GROUP BY 1""")
def doc_context(s: SparkSession, d: str) -> DataFrame:
    p = _props(s, d).select("doc_id", F.coalesce("sent_idx", F.lit(0)).alias("s"), "prop_idx", "text").distinct()
    return graph.ordered_text(p, "doc_id", ["s", "prop_idx", "text"], F.concat(F.lit("["), F.col("s").cast("string"), F.lit("] "), "text"), "\n")


@query("""WITH p AS (SELECT DISTINCT doc_id, coalesce(sent_idx, 0) AS s, prop_idx, text FROM propositions)
    SELECT doc_id, string_agg(text, ' ' ORDER BY s, prop_idx, text) AS text FROM p GROUP BY 1""")
def doc_rebuild(s: SparkSession, d: str) -> DataFrame:
    p = _props(s, d).select("doc_id", F.coalesce("sent_idx", F.lit(0)).alias("s"), "prop_idx", "text").distinct()
    return graph.ordered_text(p, "doc_id", ["s", "prop_idx", "text"], F.col("text"), " ")


@query(f"WITH {_MENTS} SELECT doc_id, text, entity_id, type, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seen_at, coalesce(type, '')) AS k FROM ments) WHERE k = 1")
def entity_first_dedupe(s: SparkSession, d: str) -> DataFrame:
    return graph.first_by(_mentions(s, d).select("doc_id", "text", "entity_id", "type", "seen_at"), ["doc_id", "text"], [F.col("seen_at"), F.coalesce("type", F.lit(""))])


@query("SELECT DISTINCT entity_id, doc_id || '_ent_' || replace(replace(replace(text, ' ', '_'), '\"', ''), '''', '') AS made_id FROM entities")
def entity_keys(s: SparkSession, d: str) -> DataFrame:
    return _mentions(s, d).select("entity_id", T.entity_id("doc_id", "text").alias("made_id")).distinct()


@query("SELECT DISTINCT node_id, doc_id || '_prop_' || prop_idx AS made_id FROM propositions")
def proposition_keys(s: SparkSession, d: str) -> DataFrame:
    return _props(s, d).select("node_id", T.proposition_id("doc_id", "prop_idx").alias("made_id")).distinct()


_DEGREE = "deg AS (SELECT n.node_id, count(e.dst) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.node_id AND e.edge_type = 'MENTIONS_ENTITY' WHERE n.node_type = 'proposition' GROUP BY 1)"


@query(f"{_GRAPH}, {_DEGREE} SELECT * FROM deg")
def entity_degree(s: SparkSession, d: str) -> DataFrame:
    return graph.entity_degree(_nodes(s, d), _edges(s, d))


@query(f"{_GRAPH}, {_DEGREE} SELECT greatest(median(degree), round(avg(degree), 6)) AS norm, median(degree) AS median, round(avg(degree), 6) AS mean, count(*) AS count FROM deg WHERE degree > 0")
def global_stats(s: SparkSession, d: str) -> DataFrame:
    return graph.global_statistics(graph.entity_degree(_nodes(s, d), _edges(s, d)))


_ADJ = f"adj AS (SELECT e.src AS node_id, CASE WHEN e.edge_type = 'MENTIONS_ENTITY' THEN e.edge_type ELSE {_COARSE.format('e.edge_type')} END AS edge_type, e.dst AS neighbour, n.node_type AS neighbour_type FROM edges e JOIN nodes n ON n.node_id = e.dst)"


@query(f"{_GRAPH}, {_ADJ} SELECT * FROM adj")
def adjacency(s: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_nodes(s, d), _edges(s, d))


@query(f"""WITH {_NODES}
    SELECT 'doc_propositions' AS mapping, doc_id AS key, count(*) AS n, min(node_id) AS first_member, max(node_id) AS last_member FROM nodes WHERE node_type = 'proposition' GROUP BY 2
    UNION ALL SELECT 'doc_entities', doc_id, count(*), min(node_id), max(node_id) FROM nodes WHERE node_type = 'entity' GROUP BY 2
    UNION ALL SELECT 'entity_docs', text, count(DISTINCT doc_id), min(doc_id), max(doc_id) FROM nodes WHERE node_type = 'entity' GROUP BY 2""")
def node_mappings(s: SparkSession, d: str) -> DataFrame:
    return graph.node_mappings(_nodes(s, d))


@query(f"""WITH {_NODES} SELECT n.doc_id, coalesce(nullif(trim(max(d.title), ' '), ''), n.doc_id) AS title, count(*) FILTER (node_type = 'proposition') AS proposition_count, count(*) FILTER (node_type = 'entity') AS entity_count
    FROM nodes n LEFT JOIN documents d ON d.doc_key = n.doc_id WHERE n.doc_id <> '' GROUP BY n.doc_id""")
def doc_metadata(s: SparkSession, d: str) -> DataFrame:
    return graph.document_metadata(_nodes(s, d), _documents(s, d))


@query(f"WITH {_NODES} SELECT lower(trim(text)) AS name, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_docs, min(node_id) AS first_node FROM nodes WHERE node_type = 'entity' AND trim(text) <> '' GROUP BY 1")
def entity_lookup(s: SparkSession, d: str) -> DataFrame:
    return graph.entity_lookup(_nodes(s, d))


@query(f"""WITH {_NODES}, e AS (SELECT node_id, lower(trim(text)) AS name, regexp_split_to_array(lower(trim(text)), '\\s+') AS w FROM nodes WHERE node_type = 'entity' AND trim(text) <> ''),
    a AS (SELECT node_id, 0 AS place, name AS alias FROM e UNION ALL SELECT node_id, 1, w[len(w)] FROM e UNION ALL SELECT node_id, 2, w[1] FROM e)
    SELECT alias, node_id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY place, node_id) AS k FROM a) WHERE k = 1""")
def entity_aliases(s: SparkSession, d: str) -> DataFrame:
    return graph.entity_aliases(_nodes(s, d))


@query(f"""WITH {_NODES}, look AS (SELECT lower(trim(text)) AS name, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_docs, min(node_id) AS first_node FROM nodes WHERE node_type = 'entity' AND trim(text) <> '' GROUP BY 1)
    SELECT f.name, n_nodes, first_node FROM (SELECT DISTINCT lower(trim(fused_text)) AS name FROM fused_entities WHERE fused_text IS NOT NULL) f LEFT JOIN look USING (name)""")
def name_lookup(s: SparkSession, d: str) -> DataFrame:
    names = read_table(s, d, "fused_entities").filter("fused_text IS NOT NULL").select(F.lower(F.trim("fused_text")).alias("name")).distinct()
    return graph.name_lookup(names, graph.entity_lookup(_nodes(s, d))).select("name", "n_nodes", "first_node")


# Vectors --------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT unnest(node_ids) AS node_id, unnest(embeddings) AS vec FROM embedding_responses), u AS (SELECT DISTINCT node_id, vec FROM v WHERE vec IS NOT NULL AND len(vec) = 64)
    SELECT u.node_id, p.doc_id, p.sent_idx, substr(p.text, 1, 100) AS digest, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS norm
    FROM u JOIN (SELECT DISTINCT node_id, doc_id, sent_idx, text FROM propositions) p ON p.node_id = u.node_id""")
def vector_payloads(s: SparkSession, d: str) -> DataFrame:
    v = read_table(s, d, "embedding_responses").select(F.explode(F.arrays_zip("node_ids", "embeddings")).alias("e")).select(F.col("e.node_ids").alias("node_id"), F.col("e.embeddings").alias("vec")).filter("size(vec) = 64").distinct()
    p = _props(s, d).select("node_id", "doc_id", "sent_idx", F.substring("text", 1, 100).alias("digest"))
    from ..functions.vector import norm

    return v.join(p, "node_id").select("node_id", "doc_id", "sent_idx", "digest", F.round(norm(F.col("vec")), 6).alias("norm"))


_COS = "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6)"
_KNN = f"knn AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {_COS} AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS item_rank FROM knn)"


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(s, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


@query(f"WITH {_KNN} SELECT query_id, item_id, similarity, item_rank FROM top WHERE item_rank <= 10")
def knn_batch(s: SparkSession, d: str) -> DataFrame:
    return knn.knn_join(*_vectors(s, d), k=10)


@query(f"WITH {_KNN} SELECT query_id, item_id, similarity, item_rank FROM top WHERE item_rank <= 20 AND similarity >= 0.3 AND query_id <> item_id")
def knn_threshold(s: SparkSession, d: str) -> DataFrame:
    return knn.knn_join(*_vectors(s, d), k=20, threshold=0.3).filter("query_id <> item_id")


@query()
def knn_lsh(s: SparkSession, d: str) -> DataFrame:
    return knn.lsh_join(*_vectors(s, d), k=10)


_CAND = """m AS (SELECT id1, id2, doc_id1, doc_id2, max(similarity) AS similarity FROM candidate_pairs WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL),
    cand AS (SELECT id1, id2, doc_id1, doc_id2, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY similarity DESC, id2) AS k FROM m) WHERE k <= 100 AND id1 <> id2 AND doc_id1 <> doc_id2 AND similarity >= 0.85)"""


@query(f"WITH {_CAND} SELECT * FROM cand")
def cross_doc_pairs(s: SparkSession, d: str) -> DataFrame:
    return knn.candidate_pairs(read_table(s, d, "candidate_pairs"), 100, 0.85)


@query(f"WITH {_CAND} SELECT id1, id2, similarity FROM (SELECT *, row_number() OVER (PARTITION BY least(id1, id2), greatest(id1, id2) ORDER BY similarity DESC, id1) AS j FROM cand) WHERE j = 1")
def pair_dedupe(s: SparkSession, d: str) -> DataFrame:
    c = knn.candidate_pairs(read_table(s, d, "candidate_pairs"), 100, 0.85)
    return knn.unordered_pairs(c.select("id1", "id2", "similarity"), [-F.col("similarity"), F.col("id1")])


@query(f"""WITH {_CAND} SELECT doc_id1, count(*) AS n, sum(length(coalesce(d.text, ''))) AS context_chars FROM cand c LEFT JOIN documents d ON d.doc_key = c.doc_id1 GROUP BY 1""")
def pair_contexts(s: SparkSession, d: str) -> DataFrame:
    c = knn.candidate_pairs(read_table(s, d, "candidate_pairs"), 100, 0.85)
    docs = _documents(s, d).select(F.col("doc_key").alias("doc_id1"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return c.groupBy("doc_id1").agg(F.count(F.lit(1)).alias("n")).join(docs, "doc_id1", "left").select("doc_id1", "n", (F.col("n") * F.coalesce("chars", F.lit(0))).alias("context_chars"))


# Linking and fusion ---------------------------------------------------------------------------------


@query()
def leader_groups(s: SparkSession, d: str) -> DataFrame:
    lists = read_table(s, d, "candidate_pairs").filter("type1 = 'entity' AND type2 = 'entity'")
    return linking.leader_groups(knn.candidate_pairs(lists, 20, 0.9).select(F.col("id1").alias("leader"), F.col("id2").alias("member")))


_MEMBERS = "g AS (SELECT DISTINCT group_id, entity_ids, entity_texts, entity_types, similarities FROM entity_candidate_groups), members AS (SELECT * FROM (SELECT group_id, unnest(entity_ids) AS id, unnest(entity_texts) AS text, unnest(entity_types) AS type, unnest(similarities) AS similarity FROM g) WHERE id IS NOT NULL)"


def _members(s: SparkSession, d: str) -> DataFrame:
    return linking.exploded_groups(read_table(s, d, "entity_candidate_groups"))


@query(f"""WITH {_MEMBERS}, same AS (SELECT group_id, count(DISTINCT coalesce(text, '') || chr(1) || coalesce(type, '')) = 1 AS same FROM members GROUP BY 1),
    r AS (SELECT m.*, same, row_number() OVER (PARTITION BY m.group_id ORDER BY coalesce(similarity, -1) DESC, id) AS rn FROM members m JOIN same USING (group_id))
    SELECT group_id, CASE WHEN same THEN 'auto' ELSE 'judge' END AS kind, CAST(CASE WHEN same THEN 0 ELSE (rn - 1) // 20 END AS INTEGER) AS part, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def auto_vs_judge_split(s: SparkSession, d: str) -> DataFrame:
    return linking.split_groups(_members(s, d))


@query(f"WITH {_MEMBERS}, z AS (SELECT group_id, count(*) AS members FROM members GROUP BY 1) SELECT members, count(*) AS n FROM z GROUP BY 1")
def group_size_hist(s: SparkSession, d: str) -> DataFrame:
    return _members(s, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).groupBy("members").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT least(id1, id2) AS lo, greatest(id1, id2) AS hi, count(*) AS verdicts, count(*) FILTER (coalesce(should_link, false)) AS yes, round(max(CASE WHEN should_link THEN confidence ELSE 0 END), 6) AS confidence
    FROM (SELECT DISTINCT decision_id, id1, id2, should_link, confidence FROM linking_decisions) WHERE id1 IS NOT NULL AND id2 IS NOT NULL AND id1 <> id2 GROUP BY 1, 2""")
def link_decisions(s: SparkSession, d: str) -> DataFrame:
    x = _decisions(s, d).filter("id1 IS NOT NULL AND id2 IS NOT NULL AND id1 <> id2")
    return x.groupBy(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).agg(F.count(F.lit(1)).alias("verdicts"), F.count_if(F.coalesce("should_link", F.lit(False))).alias("yes"), F.round(F.max(F.when(F.col("should_link"), F.col("confidence")).otherwise(0.0)), 6).alias("confidence"))


_VALID = f"""{_MEMBERS}, f AS (SELECT DISTINCT fused_id, group_id, id FROM (SELECT fused_id, group_id, unnest(original_ids) AS id FROM fused_entities) WHERE id IS NOT NULL),
    inside AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM members m WHERE m.group_id = f.group_id AND m.id = f.id)),
    valid AS (SELECT fused_id, group_id, id FROM (SELECT *, count(*) OVER (PARTITION BY fused_id) AS n FROM inside) WHERE n > 1),
    map AS (SELECT id, max(fused_id) AS fused_id FROM valid GROUP BY 1)"""
_GLOBAL = f"""{_VALID}, {_MENTS}, ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seen_at, coalesce(text, '')) AS k FROM ments) WHERE k = 1),
    gl AS (SELECT fused_id, min(id) || '_fused_' || fused_id AS global_id, arg_min(text, struct_pack(a := length(text), b := text)) AS text,
        ['PERSON', 'ORGANIZATION', 'LOCATION', 'DATE', 'NUMBER', 'MISC'][min(coalesce(list_position(['PERSON', 'ORGANIZATION', 'LOCATION', 'DATE', 'NUMBER', 'MISC'], type), 6))] AS entity_type,
        count(DISTINCT id) AS member_count, count(DISTINCT doc_id) AS n_docs FROM valid v JOIN ent e ON e.entity_id = v.id GROUP BY fused_id)"""


def _valid(s: SparkSession, d: str) -> DataFrame:
    return linking.valid_fusions(read_table(s, d, "fused_entities"), _members(s, d))


@query(f"WITH {_VALID} SELECT * FROM valid")
def fused_valid(s: SparkSession, d: str) -> DataFrame:
    return _valid(s, d)


@query(f"WITH {_VALID} SELECT * FROM map")
def fusion_map(s: SparkSession, d: str) -> DataFrame:
    return linking.fusion_map(_valid(s, d))


@query(f"WITH {_GLOBAL} SELECT * FROM gl")
def fused_globals(s: SparkSession, d: str) -> DataFrame:
    return linking.global_entities(_valid(s, d), _mentions(s, d))


def _fusion(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _valid(s, d)
    return linking.fusion_map(v), linking.global_entities(v, _mentions(s, d))


@query(f"""WITH {_GLOBAL}, {_PROPS}, met AS (SELECT DISTINCT p.node_id AS p, m.entity_id AS e FROM ments m JOIN props p ON p.doc_id = m.doc_id AND p.prop_idx = m.prop_idx),
    t AS (SELECT map.id, gl.global_id FROM map JOIN gl USING (fused_id)), r AS (SELECT DISTINCT p, coalesce(t.global_id, e) AS e FROM met LEFT JOIN t ON t.id = met.e)
    SELECT p AS src, e AS dst FROM r UNION ALL SELECT e, p FROM r""")
def fused_edges(s: SparkSession, d: str) -> DataFrame:
    return linking.redirect_edges(graph.mention_edges(_mentions(s, d), _props(s, d)), *_fusion(s, d))


@query(f"""WITH {_NODES}, {_GLOBAL.replace(_MENTS + ', ', '')}
    SELECT node_type, count(*) AS n, sum(length(text)) AS chars FROM (SELECT node_type, text FROM nodes WHERE node_id NOT IN (SELECT id FROM map) UNION ALL SELECT 'global_entity', text FROM gl) GROUP BY 1""")
def fused_stats(s: SparkSession, d: str) -> DataFrame:
    return linking.fused_nodes(_nodes(s, d), *_fusion(s, d)).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# Scoring and traversal ------------------------------------------------------------------------------

_HASH = "list_transform(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], lambda h: len(list_filter(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: md5(w)[1] = h))::DOUBLE)"
_SIM = "CASE WHEN sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) = 0 THEN 0.0 ELSE round(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))), 6) END"
_QV = f"qv AS (SELECT question_id, {_HASH.format('question')} AS q, {_HASH.format('title')} AS g FROM (SELECT DISTINCT question_id, question, title FROM test_questions) WHERE question_id % 50 = 0)"
_PV = f"pv AS (SELECT node_id, doc_id, {_HASH.format('text')} AS v FROM (SELECT DISTINCT node_id, doc_id, text FROM propositions))"
_SEM = f"sem AS (SELECT question_id, node_id, doc_id, {_SIM.format('q', 'v')} AS semantic FROM qv, pv), anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY semantic DESC, node_id) AS anchor_rank FROM sem) WHERE anchor_rank <= 10)"


def _questions(s: SparkSession, d: str) -> DataFrame:
    q = read_table(s, d, "test_questions").select("question_id", "question", "title").distinct().filter("question_id % 50 = 0")
    return q.select("question_id", hashed_words("question").alias("vec"), hashed_words("title").alias("gap"))


_ROOTS: dict[tuple, str] = {}


def _stored(s: SparkSession, d: str, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What questions are answered from, made by the first query that needs it and read by all others.

    It is made again when a file of the tables it comes from has changed.
    """
    files = tuple(sorted(f for t in ("documents", "propositions", "entities", "linking_decisions") for f in read_table(s, d, t).inputFiles()))
    conf, path = s.sparkContext._jsc.hadoopConfiguration(), s._jvm.org.apache.hadoop.fs.Path
    status = [p.getFileSystem(conf).getFileStatus(p) for p in map(path, files)]
    key = (s.sparkContext.applicationId, files, tuple((x.getLen(), x.getModificationTime()) for x in status))
    if key not in _ROOTS:
        _ROOTS[key] = Scratch(s, "known").root
    return load_or_compute(s, f"{_ROOTS[key]}/{name}", compute)


def _adjacency(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d, "adjacency", lambda: graph.adjacency(_nodes(s, d), _edges(s, d)))


def _norm(s: SparkSession, d: str) -> float:
    mentions = _adjacency(s, d).select(F.col("node_id").alias("src"), "edge_type")
    one = _stored(s, d, "global_statistics", lambda: graph.global_statistics(graph.entity_degree(_nodes(s, d), mentions))).first()
    return one["norm"] if one else 1.0


def _prop_vectors(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d, "node_vectors", lambda: _props(s, d).select("node_id", "doc_id", hashed_words("text").alias("vec")))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    items = _prop_vectors(s, d).select(F.col("node_id").alias("item_id"), "vec")
    top = knn.knn_join(_questions(s, d).select(F.col("question_id").alias("query_id"), "vec"), items, Settings.anchor_k)
    return top.select(F.col("query_id").alias("question_id"), F.col("item_id").alias("node_id"), F.col("similarity").alias("semantic"), F.col("item_rank").alias("anchor_rank"))


@query(f"WITH {_QV}, {_PV}, {_SEM} SELECT question_id, node_id, semantic, anchor_rank FROM anchors")
def semantic_anchors(s: SparkSession, d: str) -> DataFrame:
    return _anchors(s, d)


@query(f"""{_GRAPH}, {_DEGREE} SELECT node_id, degree, round(least(1.0, ln(1 + degree) / ln(1 + (SELECT greatest(median(degree), round(avg(degree), 6)) FROM deg WHERE degree > 0))), 6) AS bridge FROM deg""")
def bridge_score(s: SparkSession, d: str) -> DataFrame:
    deg = graph.entity_degree(_nodes(s, d), _edges(s, d))
    one = graph.global_statistics(deg).select("norm")
    return deg.crossJoin(F.broadcast(one)).select("node_id", "degree", traversal.bridge_score(F.col("degree"), F.col("norm")).alias("bridge"))


@query(f"""WITH {_QV}, {_PV}, {_SEM} SELECT a.question_id, a.node_id, round(0.6 * semantic + 0.4 * {_SIM.format('qv.g', 'pv.v')}, 6) AS priority FROM anchors a JOIN qv USING (question_id) JOIN pv ON pv.node_id = a.node_id""")
def anchor_priority(s: SparkSession, d: str) -> DataFrame:
    a = _anchors(s, d).select("question_id", "node_id").join(_prop_vectors(s, d).select("node_id", "vec"), "node_id")
    q = _questions(s, d)
    return traversal.anchor_priority(a, q, q.select("question_id", F.col("gap").alias("vec")))


_EXPAND = """cand AS (
    SELECT DISTINCT a.question_id, a.node_id, j.neighbour AS "to" FROM anchors a JOIN adj j ON j.node_id = a.node_id WHERE j.edge_type IN ('SKELETON', 'DETAIL', 'SIMILARITY') AND j.neighbour_type = 'proposition' AND j.neighbour <> a.node_id
    UNION SELECT DISTINCT a.question_id, a.node_id, j.neighbour FROM anchors a JOIN adj i ON i.node_id = a.node_id AND i.edge_type = 'MENTIONS_ENTITY' AND i.neighbour_type <> 'proposition' JOIN adj j ON j.node_id = i.neighbour AND j.edge_type = 'MENTIONS_ENTITY' AND j.neighbour_type = 'proposition' WHERE j.neighbour <> a.node_id)"""


@query(f"{_GRAPH}, {_ADJ}, {_QV}, {_PV}, {_SEM}, {_EXPAND} SELECT * FROM cand")
def neighbour_expand(s: SparkSession, d: str) -> DataFrame:
    return traversal.neighbours(_anchors(s, d).select("question_id", "node_id"), _adjacency(s, d), ["SKELETON", "DETAIL"])


@query(f"""{_GRAPH}, {_ADJ}, {_QV}, {_PV}, {_SEM}, {_EXPAND},
    seen AS (SELECT DISTINCT a.question_id, j.neighbour AS entity FROM anchors a JOIN adj j ON j.node_id = a.node_id AND j.edge_type = 'MENTIONS_ENTITY'),
    fresh AS (SELECT c.question_id, c."to", count(DISTINCT j.neighbour) AS n FROM (SELECT DISTINCT question_id, "to" FROM cand) c JOIN adj j ON j.node_id = c."to" AND j.edge_type = 'MENTIONS_ENTITY'
              WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.question_id = c.question_id AND s.entity = j.neighbour) GROUP BY 1, 2)
    SELECT c.question_id, c.node_id, c."to", coalesce(f.n, 0) AS "new" FROM cand c LEFT JOIN fresh f ON f.question_id = c.question_id AND f."to" = c."to" """)
def new_entities(s: SparkSession, d: str) -> DataFrame:
    adj = _adjacency(s, d)
    a = _anchors(s, d).select("question_id", "node_id")
    visited = a.join(adj.filter(F.col("edge_type") == graph.MENTIONS), "node_id").select("question_id", F.col("neighbour").alias("entity")).distinct()
    return traversal.new_entities(traversal.neighbours(a, adj, ["SKELETON", "DETAIL"]), adj, visited).select("question_id", "node_id", "to", "new")


def _beam(s: SparkSession, d: str) -> DataFrame:
    return traversal.beam_search(_anchors(s, d), _adjacency(s, d), _prop_vectors(s, d), _questions(s, d), _norm(s, d))


def _beam_sql() -> str:
    """The beam search written out depth by depth: the frontier's candidates, their scores, the best edges, the new nodes."""
    ctes = [f"""{_GRAPH}, {_ADJ}, {_DEGREE}, {_QV}, {_PV}, {_SEM},
    norm AS (SELECT greatest(median(degree), round(avg(degree), 6)) AS norm FROM deg WHERE degree > 0),
    adjm AS MATERIALIZED (SELECT * FROM adj), pvm AS MATERIALIZED (SELECT * FROM pv), qvm AS MATERIALIZED (SELECT * FROM qv),
    ent AS MATERIALIZED (SELECT node_id, neighbour AS entity FROM adjm WHERE edge_type = 'MENTIONS_ENTITY'),
    hop AS MATERIALIZED (SELECT node_id, neighbour AS "to" FROM adjm WHERE edge_type IN ('SKELETON', 'DETAIL', 'SIMILARITY') AND neighbour_type = 'proposition'
        UNION SELECT i.node_id, j.neighbour FROM adjm i JOIN adjm j ON j.node_id = i.neighbour AND j.edge_type = 'MENTIONS_ENTITY' AND j.neighbour_type = 'proposition' WHERE i.edge_type = 'MENTIONS_ENTITY' AND i.neighbour_type <> 'proposition'
        UNION SELECT node_id, neighbour FROM adjm WHERE edge_type = 'MENTIONS_ENTITY' AND neighbour_type = 'proposition'),
    f0 AS MATERIALIZED (SELECT DISTINCT question_id, node_id, NULL::VARCHAR AS parent, 0 AS depth, 0.0::DOUBLE AS score, 0.0::DOUBLE AS raw_score, [node_id] AS path FROM anchors),
    t0 AS MATERIALIZED (SELECT * FROM f0), v0 AS MATERIALIZED (SELECT DISTINCT question_id, entity FROM f0 JOIN ent USING (node_id))"""]
    for d in range(1, Settings.beam_depth + 1):
        ctes.append(f"""
    c{d} AS MATERIALIZED (SELECT DISTINCT f.question_id, f.raw_score, f.path, f.node_id, h."to" FROM f{d - 1} f JOIN hop h USING (node_id) WHERE h."to" <> f.node_id),
    n{d} AS MATERIALIZED (SELECT c.question_id, c."to", count(DISTINCT e.entity) AS fresh FROM (SELECT DISTINCT question_id, "to" FROM c{d}) c JOIN ent e ON e.node_id = c."to"
        WHERE NOT EXISTS (SELECT 1 FROM v{d - 1} v WHERE v.question_id = c.question_id AND v.entity = e.entity) GROUP BY 1, 2),
    s{d} AS MATERIALIZED (SELECT c.*, round(0.4 * {_SIM.format('q.q', 'p.v')} + 0.3 * CASE WHEN norm <= 0 THEN 0.0 ELSE round(least(1.0, ln(1 + coalesce(n.fresh, 0)) / ln(1 + norm)), 6) END, 6) AS score
        FROM c{d} c JOIN pvm p ON p.node_id = c."to" JOIN qvm q ON q.question_id = c.question_id LEFT JOIN n{d} n ON n.question_id = c.question_id AND n."to" = c."to", norm),
    b{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, "to", node_id) AS r FROM s{d}) WHERE r <= {Settings.beam_width}),
    f{d} AS MATERIALIZED (SELECT question_id, "to" AS node_id, arg_min(node_id, r) AS parent, {d} AS depth, arg_min(score, r) AS score, round(arg_min(raw_score, r) + arg_min(score, r), 6) AS raw_score, list_append(arg_min(path, r), "to") AS path
        FROM b{d} b WHERE NOT EXISTS (SELECT 1 FROM t{d - 1} t WHERE t.question_id = b.question_id AND t.node_id = b."to") GROUP BY question_id, "to"),
    t{d} AS MATERIALIZED (SELECT * FROM t{d - 1} UNION ALL SELECT * FROM f{d}), v{d} AS MATERIALIZED (SELECT * FROM v{d - 1} UNION SELECT question_id, entity FROM f{d} JOIN ent USING (node_id))""")
    last = Settings.beam_depth
    ctes.append(f"""
    leaves AS (SELECT question_id, array_to_string(path, ' ') AS path, raw_score, round(raw_score / len(path), 6) AS normalized_score FROM t{last} t WHERE NOT EXISTS (SELECT 1 FROM t{last} k WHERE k.question_id = t.question_id AND k.parent = t.node_id))""")
    return ",".join(ctes)


_BEAM = _beam_sql()


@query(f"{_BEAM} SELECT question_id, node_id, parent, CAST(depth AS INTEGER) AS depth, score, raw_score FROM t{Settings.beam_depth}")
def beam_tree(s: SparkSession, d: str) -> DataFrame:
    return _beam(s, d).select("question_id", "node_id", "parent", "depth", "score", "raw_score")


@query(f"{_BEAM} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY normalized_score DESC, path) AS INTEGER) AS path_rank FROM leaves) WHERE path_rank <= 10")
def beam_paths(s: SparkSession, d: str) -> DataFrame:
    paths = traversal.top_paths(traversal.leaf_paths(_beam(s, d)), 10)
    return paths.select("question_id", F.array_join("path", " ").alias("path"), "raw_score", "normalized_score", "path_rank")


@query()
def mmr_paths(s: SparkSession, d: str) -> DataFrame:
    return traversal.mmr(traversal.leaf_paths(_beam(s, d)))


# Result runs as ranked document lists ---------------------------------------------------------------

_RUNS = "runs AS (SELECT question_id, answer_id, row_number() OVER (PARTITION BY question_id ORDER BY answered_at, answer_id) AS path_rank, top_doc_ids AS docs FROM (SELECT DISTINCT answer_id, question_id, answered_at, top_doc_ids FROM answer_results)), hits AS (SELECT question_id, path_rank, unnest(docs) AS doc_id, generate_subscripts(docs, 1) - 1 AS pos FROM runs)"


def _runs(s: SparkSession, d: str) -> DataFrame:
    a = read_table(s, d, "answer_results").select("answer_id", "question_id", "answered_at", F.col("top_doc_ids").alias("docs")).distinct()
    return a.withColumn("path_rank", graph.window_rank(["question_id"], [F.col("answered_at"), F.col("answer_id")]))


@query(f"""WITH {_RUNS}, f AS (SELECT question_id, doc_id, min(struct_pack(a := path_rank, b := pos)) AS f FROM hits WHERE doc_id IS NOT NULL GROUP BY 1, 2)
    SELECT question_id, doc_id, doc_rank FROM (SELECT question_id, doc_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY f.a, f.b, doc_id) AS INTEGER) AS doc_rank FROM f) WHERE doc_rank <= 5""")
def top_docs(s: SparkSession, d: str) -> DataFrame:
    return traversal.documents_of_paths(_runs(s, d))


@query(f"""WITH {_RUNS}, a AS (SELECT question_id, doc_id, min(pos) AS pos FROM hits WHERE path_rank = 1 GROUP BY 1, 2), b AS (SELECT question_id, doc_id, min(pos) AS pos FROM hits WHERE path_rank = 2 GROUP BY 1, 2)
    SELECT question_id, doc_id, CAST(0 AS INTEGER) AS source, CAST(pos AS INTEGER) AS pos FROM a UNION ALL SELECT question_id, doc_id, 1, CAST(pos AS INTEGER) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.question_id = b.question_id AND a.doc_id IS NOT DISTINCT FROM b.doc_id)""")
def anchor_union(s: SparkSession, d: str) -> DataFrame:
    hits = _runs(s, d).select("question_id", "path_rank", F.posexplode("docs").alias("pos", "doc_id"))
    return traversal.ordered_union(hits.filter("path_rank = 1"), hits.filter("path_rank = 2"), "question_id", "doc_id")


@query(f"WITH {_RUNS} SELECT doc_id, min(question_id) AS question_id FROM hits GROUP BY 1")
def exclusive_anchor(s: SparkSession, d: str) -> DataFrame:
    return traversal.exclusive(_runs(s, d).select("question_id", F.explode("docs").alias("doc_id")), "doc_id", "question_id")


@query(f"""WITH {_RUNS}, c AS (SELECT question_id, doc_id, min(path_rank * 100 + pos) AS came FROM hits GROUP BY 1, 2)
    SELECT question_id, doc_id, came FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY came DESC, doc_id DESC) AS k FROM c) WHERE k <= 20""")
def evidence_last20(s: SparkSession, d: str) -> DataFrame:
    hits = _runs(s, d).select("question_id", "path_rank", F.posexplode("docs").alias("pos", "doc_id"))
    return traversal.keep_last(hits, "question_id", "doc_id", (F.col("path_rank") * 100 + F.col("pos")).cast("long"), 20).withColumnRenamed("at", "came")


@query(f"""WITH {_RUNS}, p AS (SELECT question_id, path_rank, docs, row_number() OVER (PARTITION BY question_id, docs ORDER BY path_rank) AS k FROM runs)
    SELECT question_id, CAST(path_rank AS INTEGER) AS path_rank, array_to_string(docs, ' ') AS path FROM p WHERE k = 1""")
def path_dedupe(s: SparkSession, d: str) -> DataFrame:
    paths = _runs(s, d).withColumnRenamed("docs", "path")
    return traversal.unique_paths(paths, [F.col("path_rank")]).select("question_id", "path_rank", F.array_join("path", " ").alias("path"))


@query(f"WITH {_RUNS} SELECT docs[1] AS prefix, count(*) AS n, count(DISTINCT array_to_string(docs, ' ')) AS n_paths FROM runs WHERE len(docs) > 0 GROUP BY 1")
def path_prefix(s: SparkSession, d: str) -> DataFrame:
    runs = _runs(s, d).filter(F.size("docs") > 0)
    return runs.groupBy(F.element_at("docs", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.array_join("docs", " ")).alias("n_paths"))


@query("""WITH a AS (SELECT DISTINCT answer_id, question_id, answered_at, confidence FROM answer_results WHERE confidence IS NOT NULL AND NOT isnan(confidence)),
    w AS (SELECT *, max(confidence) OVER x - min(confidence) OVER x AS spread, count(*) OVER x AS n FROM a WINDOW x AS (PARTITION BY question_id ORDER BY answered_at, answer_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT answer_id, n = 3 AND spread < 0.1 AS stop FROM w""")
def score_plateau(s: SparkSession, d: str) -> DataFrame:
    a = read_table(s, d, "answer_results").select("answer_id", "question_id", "answered_at", "confidence").distinct().filter("confidence IS NOT NULL AND NOT isnan(confidence)")
    return traversal.plateau(a.withColumn("o", F.struct("answered_at", "answer_id")), "question_id", "o", "confidence", 3, 0.1).select("answer_id", "stop")


# Text functions and evaluation ----------------------------------------------------------------------

_NORM = "trim(regexp_replace(replace(replace(replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\s.\\-]', '', 'g'), 'a ', ' '), 'an ', ' '), 'the ', ' '), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_PAIRS = "pairs AS (SELECT DISTINCT a.answer_id, a.run_id, a.short_answer, q.answer AS gold FROM answer_results a JOIN test_questions q USING (question_id))"
_TOK = f"tok AS (SELECT *, list_filter(string_split({_NORM.format('gold')}, ' '), lambda x: x <> '') AS g, list_filter(string_split({_NORM.format('short_answer')}, ' '), lambda x: x <> '') AS p FROM pairs)"
_F1 = "CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN len(g) = 0 OR len(p) = 0 THEN 0.0 ELSE round(2.0 * coalesce(list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(g, lambda x: x = t)), len(list_filter(p, lambda x: x = t))))), 0) / (len(g) + len(p)), 6) END"
_SCORED = f"{_PAIRS}, {_TOK}, scored AS (SELECT answer_id, run_id, CASE WHEN {_NORM.format('gold')} = {_NORM.format('short_answer')} THEN 1.0 ELSE 0.0 END AS em, CAST({_F1} AS DOUBLE) AS f1 FROM tok)"


def _scored(s: SparkSession, d: str) -> DataFrame:
    gold = read_table(s, d, "test_questions").groupBy("question_id").agg(F.array_sort(F.collect_set("answer")).alias("golds"))
    a = read_table(s, d, "answer_results").select("answer_id", "question_id", "run_id", "short_answer").distinct()
    return evaluation.scored_answers(a.join(gold, "question_id").drop("question_id"))


@query(f"SELECT DISTINCT answer_id, {_NORM.format('answer')} AS normalized FROM answer_results")
def normalize_answer(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "answer_results").select("answer_id", T.normalize_answer("answer").alias("normalized")).distinct()


@query(f"WITH {_SCORED} SELECT answer_id, CAST(max(em) AS DOUBLE) AS em FROM scored GROUP BY 1")
def exact_match(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("answer_id", "em")


@query(f"WITH {_SCORED} SELECT answer_id, max(f1) AS f1 FROM scored GROUP BY 1")
def token_f1(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("answer_id", "f1")


@query(f"WITH {_SCORED}, best AS (SELECT answer_id, run_id, max(em) AS em, max(f1) AS f1 FROM scored GROUP BY 1, 2) SELECT run_id, count(*) AS n, CAST(round(avg(em) * 100, 4) AS DOUBLE) AS em, round(avg(f1) * 100, 4) AS f1 FROM best GROUP BY ROLLUP (run_id)")
def eval_rollup(s: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_scored(s, d), "run_id")


_STRIP = "regexp_replace({0}, '^[{1}]+|[{1}]+$', '', 'g')"
_SHORT = _STRIP.format(_STRIP.format(_STRIP.format(_STRIP.format("coalesce(answer, '')", "\\s\\p{Z}"), '"'), "''"), "\\s\\p{Z}")


@query(f"SELECT DISTINCT answer_id, trim(regexp_replace(regexp_replace({_SHORT}, '[\\s\\p{{Z}}]+', ' ', 'g'), '[。．.!！?？;；,:，]+$', '')) AS short FROM answer_results")
def short_answer(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "answer_results").select("answer_id", T.clean_short_answer("answer").alias("short")).distinct()


@query("""SELECT DISTINCT answer_id, CASE WHEN json_valid(b) THEN b ->> '$.answer' END AS value FROM (SELECT answer_id, coalesce(nullif(regexp_extract(answer, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), ''), nullif(regexp_extract(answer, '(?s)(\\{.*\\})', 1), '')) AS b FROM answer_results)""")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "answer_results").select("answer_id", reply_field("answer", "answer").alias("value")).distinct()


@query("""WITH q AS (SELECT DISTINCT question_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS w FROM test_questions WHERE question IS NOT NULL)
    SELECT a.question_id AS q1, b.question_id AS q2, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS similarity FROM q a, q b
    WHERE a.question_id <> b.question_id AND len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.3""")
def gap_jaccard(s: SparkSession, d: str) -> DataFrame:
    q = read_table(s, d, "test_questions").filter("question IS NOT NULL").select("question_id", F.array_distinct(T.words_lower("question")).alias("w")).distinct()
    return T.jaccard_pairs(q, "question_id", "w", 0.3).select(F.col("id1").alias("q1"), F.col("id2").alias("q2"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_RUNS} SELECT r.question_id, count(*) AS attempts, CASE WHEN count(*) FILTER (a.short_answer IS NOT NULL AND a.confidence >= 0.8) > 0 THEN 'satisfied' WHEN count(*) FILTER (a.short_answer IS NOT NULL) > 0 THEN 'partially_satisfied' WHEN count(*) >= 2 THEN 'exhausted' ELSE 'active' END AS status
    FROM runs r JOIN (SELECT DISTINCT answer_id, short_answer, confidence FROM answer_results) a USING (answer_id) GROUP BY 1""")
def gap_status_machine(s: SparkSession, d: str) -> DataFrame:
    from ..operators.agent import gap_status

    a = read_table(s, d, "answer_results").select("answer_id", "question_id", "short_answer", "confidence").distinct()
    return gap_status(a, "question_id", F.col("short_answer").isNotNull() & (F.col("confidence") >= 0.8), F.col("short_answer").isNotNull())


@query("SELECT doc_id, doc_key, CAST(regexp_extract(doc_key, '^[A-Za-z0-9]+_(\\d+)$', 1) AS BIGINT) AS n, split_part(doc_key, '_', 1) AS dataset FROM documents")
def doc_numbers(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", "doc_key", evaluation.doc_number("doc_key").alias("n"), F.split_part("doc_key", F.lit("_"), F.lit(1)).alias("dataset"))


@query(f"WITH {_NODES} SELECT doc_key, source FROM documents WHERE doc_key IN (SELECT doc_id FROM nodes)")
def dataset_semi_filter(s: SparkSession, d: str) -> DataFrame:
    return evaluation.surviving(_documents(s, d).select("doc_key", "source"), _nodes(s, d))


@query(f"WITH {_NODES} SELECT doc_key, source FROM documents WHERE doc_key NOT IN (SELECT doc_id FROM nodes WHERE doc_id IS NOT NULL)")
def dataset_anti_filter(s: SparkSession, d: str) -> DataFrame:
    return evaluation.skipped(_documents(s, d).select("doc_key", "source"), _nodes(s, d))


@query(f"""WITH {_PROPS}, a AS (SELECT DISTINCT answer_id, top_doc_ids AS docs FROM answer_results)
    SELECT answer_id FROM a WHERE NOT EXISTS (SELECT 1 FROM (SELECT b.answer_id, unnest(b.docs) AS doc_id FROM a b) x WHERE x.answer_id = a.answer_id AND x.doc_id IS NOT NULL AND x.doc_id NOT IN (SELECT doc_id FROM props))""")
def facts_forall(s: SparkSession, d: str) -> DataFrame:
    a = read_table(s, d, "answer_results").select("answer_id", F.col("top_doc_ids").alias("docs")).distinct()
    return evaluation.all_facts_valid(a, _props(s, d).select("doc_id"), "answer_id", "docs", "doc_id").select("answer_id")


@query()
def agent_round(s: SparkSession, d: str) -> DataFrame:
    from ..operators.agent import run_rounds

    questions = _questions(s, d)
    names = questions.select("question_id", F.lit(1).alias("pos"), F.col("gap").alias("vec"))  # the gap is a title, which is a name
    # nodes of one text have one vector, and the smallest node wins the tie
    entities = _nodes(s, d).filter("node_type <> 'proposition'").groupBy("text").agg(F.min("node_id").alias("node_id")).select("node_id", hashed_words("text").alias("vec"))
    return run_rounds(questions, _adjacency(s, d), _prop_vectors(s, d), _norm(s, d), names=names, entities=entities)


@query(f"""{_GRAPH}, {_ADJ}, {_QV}, {_PV}, {_SEM}, {_EXPAND},
    reached AS (SELECT question_id, node_id, semantic FROM anchors UNION SELECT c.question_id, c."to", s.semantic FROM cand c JOIN sem s ON s.question_id = c.question_id AND s.node_id = c."to")
    SELECT question_id, doc_id, score, doc_rank FROM (SELECT question_id, doc_id, max(semantic) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY max(semantic) DESC, doc_id) AS INTEGER) AS doc_rank FROM reached JOIN pv USING (node_id) GROUP BY 1, 2) WHERE doc_rank <= 5""")
def retrieve_documents(s: SparkSession, d: str) -> DataFrame:
    return flagship(s, d)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Documents to graph to anchors, one hop, and the five best documents of every question."""
    adj = _adjacency(s, d)
    anchors = _anchors(s, d).select("question_id", "node_id")
    hop = traversal.neighbours(anchors, adj, ["SKELETON", "DETAIL"]).select("question_id", F.col("to").alias("node_id"))
    reached = anchors.unionByName(hop).distinct().join(_prop_vectors(s, d), "node_id").join(_questions(s, d).select("question_id", F.col("vec").alias("q")), "question_id")
    best = reached.groupBy("question_id", "doc_id").agg(F.max(traversal.semantic_score(F.col("q"), F.col("vec"))).alias("score"))
    rank = graph.window_rank(["question_id"], [F.col("score").desc(), F.col("doc_id")]).cast("int")
    return best.withColumn("doc_rank", rank).filter(F.col("doc_rank") <= 5)


@query("""WITH m AS (SELECT id1, id2, max(similarity) AS s FROM candidate_pairs WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL)
    SELECT least(id1, id2) AS lo, greatest(id1, id2) AS hi, CASE WHEN max(s) >= 0.95 THEN 'SIMILARITY' WHEN max(s) >= 0.9 THEN 'DETAIL' ELSE 'NONE' END AS verdict FROM m WHERE id1 <> id2 GROUP BY 1, 2""")
def rule_judge(s: SparkSession, d: str) -> DataFrame:
    from ..models import rule_verdict

    p = read_table(s, d, "candidate_pairs").filter("similarity IS NOT NULL AND NOT isnan(similarity) AND id1 <> id2")
    best = p.groupBy(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).agg(F.max("similarity").alias("s"))
    return best.select("lo", "hi", rule_verdict(F.col("s")).alias("verdict"))


@query("""SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id""")
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    """A search: every vector whose id is divisible by 50 against all vectors of its label."""
    e = read_table(s, d, "embeddings")
    a, b = e.filter("vec_id % 50 = 0").alias("a"), e.alias("b")
    return a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id"))).select(F.col("a.vec_id").alias("id1"), F.col("b.vec_id").alias("id2"), F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity"))
