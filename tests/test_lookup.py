import pytest
from pyspark.sql import functions as F

from loomgraph.functions.vector import HashedWords, hashed_words
from loomgraph.models import NameFuser, SentenceExtractor, extract_documents
from loomgraph.operators import knn, linking, lookup
from loomgraph.session import shared_dir
from loomgraph.sources import documents as D
from loomgraph.sources import sinks
from loomgraph.streaming import ingest

NODES = [("e1", "entity", " Ada ", 0, "d1"), ("e2", "entity", "ADA", 0, "d2"), ("g1", "global_entity", "ada", 2, None), ("g2", "global_entity", "Ada", 5, None), ("p1", "proposition", "ada", 0, "d1"), ("e3", "entity", "  ", 0, "d3"), ("e4", "entity", None, 0, "d3"), ("e5", "entity", "Bo", None, "d3")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, node_type string, text string, member_count long, doc_id string")


def test_names(spark, nodes):
    rows = {(r["name"], r["kind"], r["place"]): r["node_id"] for r in lookup.lookup_rows(nodes).collect()}
    assert rows == {("ada", "entity", 1): "e1", ("ada", "entity", 2): "e2", ("ada", "global_entity", 1): "g2", ("ada", "global_entity", 2): "g1", ("bo", "entity", 1): "e5"}
    names = spark.createDataFrame([("ADA ",), ("nobody",), ("bo",)], "name string")
    assert {tuple(r) for r in lookup.lookup_names(names, lookup.best_nodes(nodes)).collect()} == {("ADA ", "g2"), ("nobody", None), ("bo", "e5")}
    assert {tuple(r) for r in lookup.lookup_names(names, lookup.best_nodes(nodes, prefer_global=False), "inner").collect()} == {("ADA ", "e1"), ("bo", "e5")}
    assert {tuple(r) for r in lookup.lookup_statistics(nodes).collect()} == {("entity", 2, 3), ("global_entity", 1, 2)}
    assert lookup.lookup_rows(nodes.limit(0)).count() == lookup.best_nodes(nodes.limit(0)).count() == 0


def test_mappings_signatures_positions(spark, nodes):
    m = {tuple(r) for r in lookup.mapping_rows(nodes.filter("doc_id = 'd1'")).collect()}
    assert m == {("proposition_doc", "p1", "d1"), ("doc_propositions", "d1", "p1"), ("entity_docs", "e1", "d1"), ("doc_entities", "d1", "e1")}
    members = spark.createDataFrame([("g", "x", "d2", "ADA", None)], "group_id string, id string, doc_id string, text string, type string")
    typed = nodes.withColumn("entity_type", F.lit(None).cast("string"))
    assert {tuple(r) for r in lookup.same_signature(members, typed).collect()} == {("g", "x"), ("g", "e2")}
    lists = spark.createDataFrame([(1, ["c", "zz", "a"]), (2, None), (3, [])], "k long, docs array<string>")
    have = spark.createDataFrame([("a",), ("c",), ("c",)], "doc string")
    assert {tuple(r) for r in lookup.listed_documents(lists, have, "k", "docs", "doc").collect()} == {(1, 0, "c"), (1, 2, "a")}
    ids = spark.createDataFrame([("hotpot_0",), ("hotpot_1",), ("odd",), ("hotpot_9",)], "doc_id string")
    titles = spark.createDataFrame([(0, "A"), (1, "")], "pos long, title string")
    assert [tuple(r) for r in lookup.titles_by_position(ids, titles).collect()] == [("hotpot_0", "A")]
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "doc_id string")
    assert {r[0] for r in lookup.missing_titles(one("a", "b"), one("b", "c", "e"), one("a", "c")).collect()} == {"a", "b", "e"}


def test_embeddings(spark, nodes):
    texts = spark.createDataFrame([("ada lee",), ("ada lee",), ("bo",), (None,), ("  ",)], "text string")
    cache = spark.createDataFrame([("bo", [1.0] * 16)], "text string, vec array<double>").select(F.md5("text").alias("key"), "vec")
    got = {r["text"]: r for r in lookup.embedded(texts, cache, HashedWords, 16).collect()}
    assert set(got) == {"ada lee", "bo", "  "} and got["bo"]["hit"] and got["bo"]["vec"] == [1.0] * 16 and sum(got["ada lee"]["vec"]) == 2 and got["  "]["vec"] == [0.0] * 16
    assert tuple(lookup.cache_statistics(lookup.embedded(texts, cache, HashedWords, 16)).first()) == (3, 1, 0.333333)
    same = spark.createDataFrame([("Ada  the_2nd, Émile!",)], "t string").select(hashed_words("t").alias("v")).first()["v"]
    assert sum(same) == sum(HashedWords().embed(["Ada  the_2nd, Émile!"])[0])
    index = lookup.node_index(nodes.filter("text IS NOT NULL"), HashedWords).select("node_id", "vec")
    assert {r["node_id"] for r in index.collect()} == {"e1", "e2", "g1", "g2", "p1", "e5"}
    more = lookup.add_vectors(index, spark.createDataFrame([("e1", [9.0]), ("new", [8.0])], "node_id string, vec array<double>"))
    assert more.count() == 7
    got = {r["label"]: r["vec"] for r in lookup.vectors_of(spark.createDataFrame([("e1",), ("none",)], "label string"), more).collect()}
    assert got == {"e1": [9.0], "none": None}


def test_neighbour_pairs_take_k_first(spark):
    v = spark.createDataFrame([("a", "d1", [1.0, 0.0]), ("b", "d1", [1.0, 0.01]), ("c", "d2", [1.0, 0.02]), ("d", "d2", [0.0, 1.0]), ("n", "d3", None), ("z", "d3", [0.0, 0.0])], "node_id string, doc_id string, vec array<double>")
    pairs = lambda k: {(r["id1"], r["id2"]) for r in knn.neighbour_pairs(v, k, 0.9).collect()}
    assert pairs(3) == {("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")}
    assert pairs(1) == set()  # the nearest of each is itself
    asked = v.withColumn("asked", F.col("node_id") == "a")
    assert {(r["id1"], r["id2"]) for r in knn.neighbour_pairs(asked, 3, 0.9).collect()} == {("a", "c")}
    found, groups = linking.generate_candidates(v, v, k=3, threshold=0.9, entity_k=3, entity_threshold=0.9)
    assert {(r["id1"], r["id2"]) for r in found.collect()} in ({("a", "c"), ("b", "c")}, {("a", "c"), ("c", "b")})
    assert {tuple(r) for r in groups.collect()} == {("a", "c"), ("b", "c")}
    assert knn.neighbour_pairs(v.limit(0), 3, 0.9).count() == 0


def test_knn_join_ties_nulls_and_types(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 0.0]), (6, [1.0])], "item_id long, vec array<double>")
    q = spark.createDataFrame([((7, "x"), [1.0, 0.0]), ((8, "y"), [0.0, 0.0]), ((9, "z"), None)], "query_id struct<a:long,b:string>, vec array<double>")
    got = [(r["query_id"]["a"], r["item_id"], r["similarity"], r["item_rank"]) for r in knn.knn_join(q, v, 4).orderBy("query_id", "item_rank").collect()]
    assert got == [(7, 1, 1.0, 1), (7, 2, 1.0, 2), (7, 3, 1.0, 3), (7, 4, 0.0, 4), (8, 1, 0.0, 1), (8, 2, 0.0, 2), (8, 3, 0.0, 3), (8, 4, 0.0, 4)]
    assert knn.knn_join(q.limit(0), v, 4).count() == 0 == knn.knn_join(q, v.limit(0), 4).count()


def test_groups_and_fusion(spark):
    m = [("g", f"i{i:02d}", "Ada" if i % 2 else "ada", "PERSON", 1.0 - i / 100) for i in range(25)] + [("h", "a", "Bo", None, None), ("h", "b", "Bo", None, 0.5), ("s", "x", "Solo", None, None)]
    members = spark.createDataFrame(m, "group_id string, id string, text string, type string, similarity double")
    packed = {(r["group_id"], r["kind"], r["part"]): [e["id"] for e in r["entities"]] for r in linking.packed_groups(members).collect()}
    assert packed == {("g", "judge", 0): [f"i{i:02d}" for i in range(20)], ("g", "judge", 1): [f"i{i:02d}" for i in range(20, 25)], ("h", "auto", 0): ["b", "a"]}
    assert {tuple(r) for r in linking.auto_fusions(members).collect()} == {("h", "a", "Bo", None, 1.0), ("h", "b", "Bo", None, 1.0)}
    groups = linking.packed_groups(members).filter("kind = 'judge'")
    replies = spark.createDataFrame([("g", 0, 'Sets {two}: {"fused_entities": [{"original_ids": ["i00", "i01", "zz"]}, {"original_ids": ["i02"]}]}'), ("g", 1, "none"), ("g", 1, None)], "group_id string, part int, reply string")
    assert {(r["part"], r["fused"], r["id"]) for r in linking.judged_fusions(groups, replies).collect()} == {(0, 0, "i00"), (0, 0, "i01")}
    assert '"a", "b"' in NameFuser().generate(["1. a | Ada | X\n2. b |  ada | Y\n3. c | Bo | \n"])[0] and NameFuser().generate([""]) != [None]


def test_extraction_of_documents(spark):
    docs = spark.createDataFrame([("d1", "[0] Ada Lee met Bo Ray.\n[1] They left."), ("d2", "")], "doc_id string, content string")
    props, ents, rels, ok = extract_documents(docs, SentenceExtractor)
    assert props.count() == 2 and {r["text"] for r in ents.collect()} == {"Ada Lee", "Bo Ray"} and rels.count() == 1 and ok.count() == 2


def test_stored_indexes_and_tables(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, vec array<double>")
    sinks.save_index(v, f"{tmp_path}/ix", 2)
    assert D.index_dim(spark, f"{tmp_path}/ix") == 2 and D.load_checked_index(spark, f"{tmp_path}/ix").count() == 1
    sinks.save_index(v, f"{tmp_path}/bad", 3)
    with pytest.raises(Exception, match="length"):
        D.load_checked_index(spark, f"{tmp_path}/bad").collect()
    sinks.save_store({"one": v, "two": v.withColumn("node_id", F.lit("b"))}, f"{tmp_path}/store")
    assert {k: t.first()["node_id"] for k, t in D.load_store(spark, f"{tmp_path}/store").items()} == {"one": "a", "two": "b"}
    made = []
    compute = lambda: made.append(1) or v
    assert D.load_or_compute(spark, f"{tmp_path}/t", compute).count() == D.load_or_compute(spark, f"{tmp_path}/t", compute).count() == len(made) == 1
    (tmp_path / "half").mkdir()  # a table whose writing was cut short is made again
    assert D.load_or_compute(spark, f"{tmp_path}/half", compute).count() == 1 and len(made) == 2
    sinks.save_candidates(v, v, v, f"{tmp_path}/c")
    sinks.save_evaluation(v, v, f"{tmp_path}/e")
    assert D.load_artefacts(spark, f"{tmp_path}/c")["pairs"].count() == 1
    with pytest.raises(Exception):
        D.load_artefacts(spark, f"{tmp_path}/c", ("missing",))


def test_shared_folder_is_demanded_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Fake)


def test_upsert_survives_a_lost_overwrite(spark, tmp_path):
    """A batch that died while it was overwriting is run again from its whole staged copy."""
    src, table, state = f"{tmp_path}/src", f"{tmp_path}/table", f"{tmp_path}/state"
    schema = "node_id string, text string, seq long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([(f"n{i}", "old", 1) for i in range(50)])
    run = lambda: ingest.upsert_nodes(spark.readStream.schema(schema).parquet(src), table, state, buckets=4).trigger(availableNow=True).start().awaitTermination()
    run()
    write([("n1", "new", 2), ("x", "new", 2)])
    run()
    have = {r["node_id"]: r["text"] for r in spark.read.parquet(table).collect()}
    assert len(have) == 51 and have["n1"] == "new" and have["n2"] == "old"
    import os
    import shutil

    for b in os.listdir(table):  # the overwrite of the second batch lost its buckets, and its commit was never written
        if b.startswith("bucket="):
            shutil.rmtree(f"{table}/{b}")
            break
    lost = 51 - spark.read.parquet(table).count()
    assert lost > 0
    commits = f"{state}/state/commits"
    last = max(int(c) for c in os.listdir(commits) if c.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    run()
    back = {r["node_id"] for r in spark.read.parquet(table).collect()}
    staged = {r["node_id"] for r in spark.read.parquet(f"{state}/staged/{last}").collect()}
    assert staged <= back and {"n1", "x"} <= staged
