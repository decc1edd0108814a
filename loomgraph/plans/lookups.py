"""Registered queries over lookups, candidates, fusion and stored artefacts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vector import HashedWords, hashed_words, norm
from ..operators import graph, knn, linking, lookup, traversal
from ..session import Scratch, read_table
from ..sources import documents as sources
from ..sources import sinks
from .catalogue import _EDGES, _GLOBAL, _GRAPH, _HASH, _MEMBERS, _MENTS, _NODES, _PROPS, _SIM, _VALID, _documents, _edges, _fusion, _members, _mentions, _nodes, _props, _valid, query

# Names ----------------------------------------------------------------------------------------------

_NAMED = f"""WITH {_NODES}, {_GLOBAL.replace(_MENTS + ', ', '')},
    named AS (SELECT node_id, 'entity' AS kind, lower(trim(text)) AS name, 0 AS member_count FROM nodes WHERE node_type = 'entity' AND trim(text) <> ''
              UNION ALL SELECT global_id, 'global_entity', lower(trim(text)), member_count FROM gl WHERE trim(text) <> '')"""


def _named_nodes(s: SparkSession, d: str) -> DataFrame:
    """Entity nodes and fused entities side by side, as lookups see them."""
    ents = _nodes(s, d).filter("node_type = 'entity'").select("node_id", "node_type", "text", F.lit(0).cast("long").alias("member_count"))
    made = linking.global_entities(_valid(s, d), _mentions(s, d))
    return ents.unionByName(made.select(F.col("global_id").alias("node_id"), F.lit("global_entity").alias("node_type"), "text", "member_count"))


@query(f"{_NAMED} SELECT name, kind, CAST(row_number() OVER (PARTITION BY name, kind ORDER BY member_count DESC, node_id) AS INTEGER) AS place, node_id FROM named")
def entity_lookup_rows(s: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_rows(_named_nodes(s, d)).withColumn("place", F.col("place").cast("int"))


@query(f"{_NAMED} SELECT kind, count(DISTINCT name) AS names, count(*) AS nodes FROM named GROUP BY kind")
def entity_lookup_stats(s: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_statistics(_named_nodes(s, d))


@query(f"""{_NAMED}, best AS (SELECT name, node_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind = 'entity', member_count DESC, node_id) AS k FROM named) WHERE k = 1)
    SELECT f.name, best.node_id FROM (SELECT DISTINCT trim(fused_text) AS name FROM fused_entities WHERE fused_text IS NOT NULL) f LEFT JOIN best ON best.name = lower(f.name)""")
def name_to_node(s: SparkSession, d: str) -> DataFrame:
    names = read_table(s, d, "fused_entities").filter("fused_text IS NOT NULL").select(F.trim("fused_text").alias("name")).distinct()
    return lookup.lookup_names(names, lookup.best_nodes(_named_nodes(s, d)))


@query(f"""WITH {_NODES}
    SELECT 'proposition_doc' AS mapping, node_id AS key, doc_id AS member FROM nodes WHERE node_type = 'proposition' UNION SELECT 'doc_propositions', doc_id, node_id FROM nodes WHERE node_type = 'proposition'
    UNION SELECT 'entity_docs', node_id, doc_id FROM nodes WHERE node_type = 'entity' UNION SELECT 'doc_entities', doc_id, node_id FROM nodes WHERE node_type = 'entity'""")
def mapping_rows(s: SparkSession, d: str) -> DataFrame:
    return lookup.mapping_rows(_nodes(s, d))


@query(f"""WITH {_NODES}, g AS (SELECT DISTINCT group_id, entity_ids, entity_texts, entity_types, doc_ids FROM entity_candidate_groups),
    m AS (SELECT DISTINCT * FROM (SELECT group_id, unnest(entity_ids) AS id, unnest(entity_texts) AS text, coalesce(unnest(entity_types), '') AS type, unnest(doc_ids) AS doc_id FROM g) WHERE id IS NOT NULL)
    SELECT group_id, n.node_id FROM m JOIN nodes n ON n.node_type = 'entity' AND n.doc_id = m.doc_id AND n.text = m.text AND coalesce(n.entity_type, '') = m.type UNION SELECT group_id, id FROM m""")
def signature_matches(s: SparkSession, d: str) -> DataFrame:
    g = read_table(s, d, "entity_candidate_groups").select("group_id", F.explode(F.arrays_zip(F.col("entity_ids").alias("id"), F.col("entity_texts").alias("text"), F.col("entity_types").alias("type"), F.col("doc_ids").alias("doc_id"))).alias("m"))
    members = g.select("group_id", "m.id", "m.text", "m.type", "m.doc_id").filter("id IS NOT NULL").distinct()
    return lookup.same_signature(members, _nodes(s, d))


@query("""WITH a AS (SELECT DISTINCT answer_id, top_doc_ids AS docs FROM answer_results), h AS (SELECT answer_id, unnest(docs) AS doc_id, CAST(generate_subscripts(docs, 1) - 1 AS INTEGER) AS place FROM a)
    SELECT answer_id, place, doc_id FROM h WHERE doc_id IN (SELECT doc_key FROM documents WHERE title IS NOT NULL)""")
def whitelisted_docs(s: SparkSession, d: str) -> DataFrame:
    lists = read_table(s, d, "answer_results").select("answer_id", F.col("top_doc_ids").alias("docs")).distinct()
    return lookup.listed_documents(lists, _documents(s, d).filter("title IS NOT NULL").select(F.col("doc_key").alias("doc_id")), "answer_id", "docs", "doc_id")


@query("""WITH e AS (SELECT DISTINCT doc_id FROM entities), p AS (SELECT DISTINCT doc_id FROM propositions)
    SELECT doc_id FROM p UNION SELECT doc_id FROM e WHERE doc_id NOT IN (SELECT doc_key FROM documents WHERE trim(coalesce(title, '')) <> '')""")
def missing_titles(s: SparkSession, d: str) -> DataFrame:
    titled = _documents(s, d).filter("trim(coalesce(title, '')) <> ''").select(F.col("doc_key").alias("doc_id"))
    return lookup.missing_titles(_props(s, d), _mentions(s, d), titled)


@query("""WITH ids AS (SELECT DISTINCT doc_id, CAST(nullif(regexp_extract(doc_id, '^[A-Za-z0-9]+_(\\d+)$', 1), '') AS BIGINT) AS pos FROM propositions)
    SELECT i.doc_id, d.title FROM ids i JOIN documents d ON d.doc_id = i.pos WHERE d.title IS NOT NULL AND d.title <> ''""")
def titles_by_position(s: SparkSession, d: str) -> DataFrame:
    return lookup.titles_by_position(_props(s, d).select("doc_id").distinct(), _documents(s, d).select(F.col("doc_id").alias("pos"), "title"))


# Vectors --------------------------------------------------------------------------------------------

_VECS = "v AS (SELECT DISTINCT node_id, vec FROM (SELECT unnest(node_ids) AS node_id, unnest(embeddings) AS vec FROM embedding_responses) WHERE vec IS NOT NULL AND len(vec) = 64 AND node_id IS NOT NULL)"


def _stored_vectors(s: SparkSession, d: str) -> DataFrame:
    v = read_table(s, d, "embedding_responses").select(F.explode(F.arrays_zip("node_ids", "embeddings")).alias("e")).select(F.col("e.node_ids").alias("node_id"), F.col("e.embeddings").alias("vec"))
    return v.filter("size(vec) = 64 AND node_id IS NOT NULL").distinct()


@query(f"WITH {_VECS}, l AS (SELECT DISTINCT id1 AS label FROM linking_decisions WHERE id1 IS NOT NULL) SELECT label, v.node_id IS NOT NULL AS found, CASE WHEN v.node_id IS NOT NULL THEN round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) END AS length FROM l LEFT JOIN v ON v.node_id = l.label")
def vector_lookup(s: SparkSession, d: str) -> DataFrame:
    labels = read_table(s, d, "linking_decisions").filter("id1 IS NOT NULL").select(F.col("id1").alias("label"))
    got = lookup.vectors_of(labels, _stored_vectors(s, d))
    return got.select("label", F.col("vec").isNotNull().alias("found"), F.round(norm(F.col("vec")), 6).alias("length"))


_CACHED = f"""t AS (SELECT text, count(DISTINCT doc_id) > 1 AS hit FROM entities WHERE text IS NOT NULL GROUP BY text), made AS (SELECT md5(text) AS key, text, hit, list_sum({_HASH.format('text')}) AS total FROM t)"""


def _embedded(s: SparkSession, d: str) -> DataFrame:
    # what several documents name is in the cache already
    mentions = read_table(s, d, "entities").filter("text IS NOT NULL")
    known = mentions.groupBy("text").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1").select(F.md5("text").alias("key"), hashed_words("text").alias("vec"))
    return lookup.embedded(mentions, known, HashedWords, 16)


@query(f"WITH {_CACHED} SELECT key, text, hit, total FROM made")
def embedded_texts(s: SparkSession, d: str) -> DataFrame:
    return _embedded(s, d).select("key", "text", "hit", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_CACHED} SELECT count(*) AS texts, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER::DOUBLE), 6) AS hit_rate FROM made")
def embedding_cache_stats(s: SparkSession, d: str) -> DataFrame:
    return lookup.cache_statistics(_embedded(s, d))


_NEAR_NAMES = f"""names AS (SELECT name, {_HASH.format('name')} AS v FROM (SELECT DISTINCT trim(text) AS name FROM nodes WHERE node_type <> 'proposition' AND trim(text) <> '')),
    asked AS (SELECT DISTINCT fused_id, {_HASH.format('fused_text')} AS q FROM fused_entities WHERE fused_id % 50 = 0 AND fused_text IS NOT NULL),
    near AS (SELECT fused_id, name, {_SIM.format('q', 'v')} AS similarity FROM asked, names),
    hit AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fused_id ORDER BY similarity DESC, name) AS INTEGER) AS item_rank FROM near) WHERE item_rank <= 5 AND similarity >= 0.7)"""


def _near_names(s: SparkSession, d: str, k: int) -> DataFrame:
    """A search: the names of every fused record whose id is divisible by 50, against all entity names."""
    asked = read_table(s, d, "fused_entities").filter("fused_id % 50 = 0 AND fused_text IS NOT NULL").select(F.col("fused_id").alias("query_id"), "fused_text").distinct().select("query_id", hashed_words("fused_text").alias("vec"))
    names = lookup.name_index(_nodes(s, d), HashedWords).select(F.col("name").alias("item_id"), "vec")
    return knn.knn_join(asked, names, k, 0.7)


@query(f"WITH {_NODES}, {_NEAR_NAMES} SELECT fused_id, name, similarity, item_rank FROM hit")
def name_search(s: SparkSession, d: str) -> DataFrame:
    return _near_names(s, d, 5).select(F.col("query_id").alias("fused_id"), F.col("item_id").alias("name"), "similarity", "item_rank")


@query(f"""WITH {_NODES}, {_NEAR_NAMES.replace("<= 5", "<= 1")} SELECT fused_id, min(n.node_id) AS node_id FROM hit JOIN nodes n ON n.node_type <> 'proposition' AND trim(n.text) = hit.name GROUP BY fused_id""")
def matched_entity_nodes(s: SparkSession, d: str) -> DataFrame:
    hit = _near_names(s, d, 1).select(F.col("query_id").alias("fused_id"), F.col("item_id").alias("name"))
    ids = _nodes(s, d).filter("node_type <> 'proposition'").groupBy(F.trim("text").alias("name")).agg(F.min("node_id").alias("node_id"))
    return hit.join(ids, "name").select("fused_id", "node_id")


_CAND = f"""WITH {_VECS}, p AS (SELECT DISTINCT prop_id, node_id, doc_id FROM propositions), n AS (SELECT p.prop_id, p.doc_id, v.* FROM v JOIN p USING (node_id)),
    pairs AS (SELECT a.node_id AS id1, b.node_id AS id2, a.doc_id AS doc_id1, b.doc_id AS doc_id2, {_SIM.format('a.vec::DOUBLE[]', 'b.vec::DOUBLE[]')} AS similarity FROM n a, n b WHERE a.prop_id % 50 = 0),
    cand AS (SELECT id1, id2, doc_id1, doc_id2, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY similarity DESC, id2) AS k FROM pairs) WHERE k <= 100 AND id1 <> id2 AND doc_id1 <> doc_id2 AND similarity >= 0.85)"""


def _proposition_vectors(s: SparkSession, d: str) -> DataFrame:
    p = _props(s, d).select("prop_id", "node_id", "doc_id").distinct()
    return _stored_vectors(s, d).join(p, "node_id").select("node_id", "doc_id", "vec", (F.col("prop_id") % 50 == 0).alias("asked"))


@query(f"{_CAND} SELECT * FROM cand")
def proposition_candidates(s: SparkSession, d: str) -> DataFrame:
    """A search: of the propositions whose id is divisible by 50 against all vectors, the cross-document candidates."""
    return knn.neighbour_pairs(_proposition_vectors(s, d), Settings.proposition_k, Settings.proposition_threshold)


_ENT_CAND = f"""ev AS (SELECT n.node_id, n.doc_id, {_HASH.format('n.text')} AS vec, coalesce(d.doc_id % 50 = 0, false) AS asked FROM nodes n LEFT JOIN documents d ON d.doc_key = n.doc_id WHERE n.node_type = 'entity' AND trim(n.text) <> ''),
    epairs AS (SELECT a.node_id AS id1, b.node_id AS id2, a.doc_id AS doc_id1, b.doc_id AS doc_id2, {_SIM.format('a.vec', 'b.vec')} AS similarity FROM ev a, ev b WHERE a.asked),
    ecand AS (SELECT id1, id2, doc_id1, doc_id2, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY similarity DESC, id2) AS k FROM epairs) WHERE k <= 20 AND id1 <> id2 AND doc_id1 <> doc_id2 AND similarity >= 0.8)"""


def _entity_vectors(s: SparkSession, d: str) -> DataFrame:
    docs = _documents(s, d).select(F.col("doc_key").alias("doc_id"), (F.col("doc_id") % 50 == 0).alias("asked"))
    n = _nodes(s, d).filter("node_type = 'entity' AND trim(text) <> ''").select("node_id", "doc_id", "text").join(docs, "doc_id", "left")
    return n.select("node_id", "doc_id", hashed_words("text").alias("vec"), F.coalesce("asked", F.lit(False)).alias("asked"))


@query(f"WITH {_NODES}, {_ENT_CAND} SELECT * FROM ecand")
def entity_candidates(s: SparkSession, d: str) -> DataFrame:
    """A search: of the entities of documents whose id is divisible by 50 against all entities."""
    return knn.neighbour_pairs(_entity_vectors(s, d), Settings.entity_k, Settings.entity_threshold)


@query(f"{_CAND} SELECT 'pairs' AS kind, count(*) AS n FROM (SELECT DISTINCT least(id1, id2), greatest(id1, id2) FROM cand)")
def candidate_pair_count(s: SparkSession, d: str) -> DataFrame:
    pairs, _ = linking.generate_candidates(_proposition_vectors(s, d), _entity_vectors(s, d))
    return pairs.agg(F.lit("pairs").alias("kind"), F.count(F.lit(1)).alias("n"))


@query(f"{_CAND} SELECT id1, id2, md5(coalesce(a.text, '')) AS context1, md5(coalesce(b.text, '')) AS context2 FROM cand LEFT JOIN documents a ON a.doc_key = doc_id1 LEFT JOIN documents b ON b.doc_key = doc_id2")
def candidate_contexts(s: SparkSession, d: str) -> DataFrame:
    cand = proposition_candidates(s, d)
    text = lambda n: _documents(s, d).select(F.col("doc_key").alias(f"doc_id{n}"), F.col("text").alias(f"text{n}"))
    met = cand.join(text(1), "doc_id1", "left").join(text(2), "doc_id2", "left")
    return met.select("id1", "id2", *[F.md5(F.coalesce(f"text{n}", F.lit(""))).alias(f"context{n}") for n in (1, 2)])


# Fusion ---------------------------------------------------------------------------------------------

_PACKED = f"""WITH {_MEMBERS}, same AS (SELECT group_id, count(DISTINCT coalesce(text, '') || chr(1) || coalesce(type, '')) = 1 AS same, count(DISTINCT id) AS n FROM members GROUP BY 1),
    r AS (SELECT m.*, same, n, row_number() OVER (PARTITION BY m.group_id ORDER BY coalesce(similarity, -1) DESC, id) AS rn FROM members m JOIN same USING (group_id)),
    packed AS (SELECT group_id, CASE WHEN same THEN 'auto' ELSE 'judge' END AS kind, CAST((rn - 1) // 20 AS INTEGER) AS part, string_agg(id, ' ' ORDER BY rn) AS ids, string_agg(rn || '. ' || id || ' | ' || coalesce(text, '') || ' | ' || coalesce(type, ''), chr(10) ORDER BY rn) AS prompt FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


@query(f"{_PACKED} SELECT group_id, kind, part, ids FROM packed")
def packed_groups(s: SparkSession, d: str) -> DataFrame:
    return linking.packed_groups(_members(s, d)).select("group_id", "kind", "part", F.array_join("entities.id", " ").alias("ids"))


@query(f"{_PACKED} SELECT group_id, part, prompt FROM packed WHERE kind = 'judge'")
def fusion_prompts(s: SparkSession, d: str) -> DataFrame:
    from ..functions.replies import entity_line

    lines = F.transform("entities", lambda e: entity_line(e["rn"], e["id"], e["text"], e["type"]))
    return linking.packed_groups(_members(s, d)).filter("kind = 'judge'").select("group_id", "part", F.array_join(lines, "\n").alias("prompt"))


@query(f"{_PACKED} SELECT DISTINCT group_id, id, text, type, CAST(1.0 AS DOUBLE) AS confidence FROM r WHERE same AND n > 1")
def auto_fusions(s: SparkSession, d: str) -> DataFrame:
    return linking.auto_fusions(_members(s, d))


@query(f"""{_PACKED}, j AS (SELECT group_id, CAST((rn - 1) // 20 AS INTEGER) AS part, id, lower(trim(coalesce(text, ''))) AS name FROM r WHERE NOT same)
    SELECT group_id, part, id, name FROM j JOIN (SELECT group_id, part, name FROM j GROUP BY ALL HAVING count(DISTINCT id) > 1) USING (group_id, part, name) GROUP BY ALL""")
def judged_fusions(s: SparkSession, d: str) -> DataFrame:
    """Groups fused by the deterministic judge, which joins members of one lower-case name."""
    from ..functions.replies import entity_line
    from ..models import NameFuser, complete

    groups = linking.packed_groups(_members(s, d)).filter("kind = 'judge'")
    lines = F.transform("entities", lambda e: entity_line(e["rn"], e["id"], e["text"], e["type"]))
    replies = complete(groups.select("group_id", "part", F.array_join(lines, "\n").alias("prompt")), "prompt", NameFuser)
    names = _members(s, d).select("group_id", "id", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("name")).distinct()
    return linking.judged_fusions(groups, replies).select("group_id", "part", "id").distinct().join(names, ["group_id", "id"]).select("group_id", "part", "id", "name")


@query(f"WITH {_VALID}, {_MENTS} SELECT DISTINCT fused_id, doc_id FROM valid v JOIN ments m ON m.entity_id = v.id")
def fused_documents(s: SparkSession, d: str) -> DataFrame:
    return linking.fused_documents(_valid(s, d), _mentions(s, d))


@query(f"""WITH {_NODES}, {_GLOBAL.replace(_MENTS + ', ', '')}, {_EDGES},
    t AS (SELECT map.id, gl.global_id FROM map JOIN gl USING (fused_id)),
    moved AS (SELECT DISTINCT coalesce(a.global_id, e.src) AS src, coalesce(b.global_id, e.dst) AS dst FROM edges e LEFT JOIN t a ON a.id = e.src LEFT JOIN t b ON b.id = e.dst WHERE e.edge_type = 'MENTIONS_ENTITY')
    SELECT src, dst, 'MENTIONS_ENTITY' AS edge_type FROM moved UNION ALL SELECT src, dst, edge_type FROM edges WHERE edge_type <> 'MENTIONS_ENTITY'""")
def fused_graph_edges(s: SparkSession, d: str) -> DataFrame:
    return linking.fuse(_nodes(s, d), _edges(s, d), read_table(s, d, "fused_entities"), _members(s, d), _mentions(s, d))[1]


@query(f"""WITH {_NODES}, {_GLOBAL.replace(_MENTS + ', ', '')}
    SELECT node_id, node_type, text, 0 AS member_count FROM nodes WHERE node_id NOT IN (SELECT id FROM map) UNION ALL SELECT global_id, 'global_entity', text, member_count FROM gl""")
def fused_graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return linking.fuse(_nodes(s, d), _edges(s, d), read_table(s, d, "fused_entities"), _members(s, d), _mentions(s, d))[0].withColumn("member_count", F.coalesce("member_count", F.lit(0)))


# Stored graphs and artefacts ------------------------------------------------------------------------


@query(f"""{_GRAPH}, way AS (SELECT * FROM edges WHERE src < dst OR edge_type <> 'MENTIONS_ENTITY'),
    rev AS (SELECT e.dst AS src, e.src AS dst, e.edge_type FROM way e WHERE (e.edge_type IN ('SIMILARITY', 'MENTIONS_ENTITY') OR e.direction = '1<->2') AND NOT EXISTS (SELECT 1 FROM way r WHERE r.src = e.dst AND r.dst = e.src))
    SELECT edge_type, count(*) AS n FROM (SELECT src, dst, edge_type FROM way UNION ALL SELECT * FROM rev) GROUP BY 1""")
def upgraded_graph(s: SparkSession, d: str) -> DataFrame:
    """A graph stored with one-way mention edges, upgraded from file to file."""
    root = Scratch(s, "upgrade").root
    edges = _edges(s, d).filter((F.col("src") < F.col("dst")) | (F.col("edge_type") != graph.MENTIONS))
    sinks.save_graph(_nodes(s, d), edges, f"{root}/old")
    sinks.upgrade_graph(s, f"{root}/old", f"{root}/new")
    return sinks.load_graph(s, f"{root}/new")[1].groupBy(F.col("edge_type").cast("string").alias("edge_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_NAMED}, {_EDGES}, {_VECS}
    SELECT 'adjacency' AS artefact, count(*) AS n FROM edges UNION ALL SELECT 'entity_degree', count(*) FROM nodes WHERE node_type = 'proposition' UNION ALL SELECT 'global_statistics', 1
    UNION ALL SELECT 'entity_names', count(DISTINCT trim(text)) FROM nodes WHERE node_type = 'entity' AND trim(text) <> ''
    UNION ALL SELECT 'node_vectors', count(*) FROM v UNION ALL SELECT 'entity_lookup', count(*) FROM named
    UNION ALL SELECT 'node_mappings', (SELECT 2 * count(*) FROM nodes WHERE doc_id IS NOT NULL)""")
def stored_artefacts(s: SparkSession, d: str) -> DataFrame:
    """All that retrieval reads, written once and read back."""
    root = Scratch(s, "artefacts").root
    nodes, edges = _nodes(s, d), _edges(s, d)
    fused = linking.global_entities(_valid(s, d), _mentions(s, d))
    sinks.persist_artefacts(nodes, edges, _documents(s, d), root, globals_=fused, vectors=_stored_vectors(s, d), names=lookup.name_index(nodes, HashedWords))
    stored = sources.load_artefacts(s, root)
    wanted = ["adjacency", "entity_degree", "global_statistics", "entity_names", "node_vectors", "entity_lookup", "node_mappings"]
    counts = [stored[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artefact"), "n") for name in wanted]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"""{_GRAPH}, n AS (SELECT (SELECT greatest(median(degree), round(avg(degree), 6)) FROM (SELECT count(e.dst) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.node_id AND e.edge_type = 'MENTIONS_ENTITY' WHERE n.node_type = 'proposition' GROUP BY n.node_id) WHERE degree > 0) AS norm)
    SELECT norm FROM n""")
def loaded_statistics(s: SparkSession, d: str) -> DataFrame:
    """Global statistics from the stored table, computed only where none is stored."""
    return sources.load_or_compute(s, f"{Scratch(s, 'stats').root}/global_statistics", lambda: graph.global_statistics(graph.entity_degree(_nodes(s, d), _edges(s, d)))).select("norm")


@query(f"""{_GRAPH}, named AS (SELECT DISTINCT fused_id AS question_id, entity AS node_id FROM (SELECT fused_id, unnest(original_ids) AS entity FROM fused_entities WHERE fused_id % 50 = 0) WHERE entity IS NOT NULL),
    f AS (SELECT * FROM (SELECT src AS entity, dst AS prop, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT e.src, e.dst FROM edges e JOIN nodes n ON n.node_id = e.dst AND n.node_type = 'proposition' WHERE e.edge_type = 'MENTIONS_ENTITY')) WHERE k <= 3)
    SELECT DISTINCT question_id, prop AS node_id FROM named JOIN f ON f.entity = named.node_id""")
def refilled_anchors(s: SparkSession, d: str) -> DataFrame:
    """A search: members of the fused records whose id is divisible by 50 as entities to refill from."""
    ents = read_table(s, d, "fused_entities").filter("fused_id % 50 = 0").select(F.col("fused_id").alias("question_id"), F.explode("original_ids").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    adj = graph.adjacency(_nodes(s, d), _edges(s, d)).filter(F.col("edge_type") == graph.MENTIONS)
    visited = s.createDataFrame([], "question_id long, node_id string")
    return traversal.refill_from_entities(ents, adj, visited).select("question_id", "node_id")
