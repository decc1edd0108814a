import datetime as dt
import json

from loomgraph import models
from loomgraph.config import Settings, merged
from loomgraph.operators import graph as G
from loomgraph.sources import documents as D
from loomgraph.sources import sinks
from loomgraph.streaming import ingest


def test_corpus_files(spark, tmp_path):
    p = tmp_path / "musique_docs.json"
    p.write_text(json.dumps([{"title": "A", "content": ["x", "y"]}, {"content": None}, {"title": "C"}]))
    rows = {r["doc_id"]: (r["title"], r["content"]) for r in D.load_documents(spark, str(p)).collect()}
    assert rows == {"musique_0": ("A", ["x", "y"]), "musique_1": ("", []), "musique_2": ("C", [])}
    assert D.dataset_prefix("/x/other.json") == "hotpot" and D.load_titles(spark, str(p)).count() == 2
    q = tmp_path / "docs.json"
    q.write_text(json.dumps([{"question": "Q?", "answer": ["a", "b"], "supporting_facts": [["T", 0], []]}, {"question": " ", "answer": "x"}, {"question": "R?", "answer": "z"}]))
    got = D.load_questions(spark, str(q)).orderBy("question_id").collect()
    assert [(r["golds"], r["facts"]) for r in got] == [(["a", "b"], ["T"]), (["z"], [])]
    j = tmp_path / "x.jsonl"
    j.write_text('{"doc_id": "k", "title": "T", "content": ["c"]}\n\n{"title": "U"}\n')
    assert sorted(r["title"] for r in D.load_jsonl(spark, str(j)).collect()) == ["T", "U"]
    assert D.find_dataset_file(str(tmp_path)).endswith("docs.json")


def test_settings(tmp_path):
    s = Settings.of({"retrieval": {"beam_depth": 3, "unknown": 1}})
    s.save(str(tmp_path / "c.yaml"))
    assert Settings.load(str(tmp_path / "c.yaml")) == s and s.beam_depth == 3
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_models(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def generate(self, prompts):
            self.calls += 1
            return ["bad" if self.calls == 1 and "x" in p else "{}" for p in prompts]

    rows = spark.createDataFrame([("d", "[0] Ann Lee met Bo Day.\n[1] x")], "doc_id string, prompt string").coalesce(1)
    done = models.complete(rows, "prompt", models.SentenceExtractor)
    props, ents, rels = models.flatten_extraction(done)
    assert [r["text"] for r in props.collect()] == ["Ann Lee met Bo Day.", "x"]
    assert {r["text"] for r in ents.collect()} == {"Ann Lee", "Bo Day"} and rels.first()["direction"] == "1->2"
    assert models.complete(rows, "prompt", Flaky, retries=1, valid=lambda r: r == "{}").first()["ok"]
    assert not models.complete(rows, "prompt", Flaky, retries=0, valid=lambda r: r == "{}").first()["ok"]


def test_sinks_and_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    props = spark.createDataFrame([(1, "d_prop_0", "d", 0, 0, "A.")], "prop_id long, node_id string, doc_id string, prop_idx int, sent_idx int, text string")
    ments = spark.createDataFrame([("d_ent_A", "d", 0, "A", "PERSON", t)], "entity_id string, doc_id string, prop_idx int, text string, type string, seen_at timestamp")
    docs = spark.createDataFrame([("d", "T")], "doc_key string, title string")
    nodes, edges = G.nodes(props, ments, docs), G.mention_edges(ments, props)
    sinks.save_graph(nodes, edges, str(tmp_path / "g"), ("parquet", "json"))
    n, e = sinks.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.count() == 2
    for name in sinks.persist_artefacts(nodes, edges, docs, str(tmp_path / "a")):
        assert spark.read.parquet(str(tmp_path / "a" / name)).count() >= 0
    src = str(tmp_path / "in")
    schema = "node_id string, text string, seq long"
    spark.createDataFrame([("n1", "old", 1), ("n2", "x", 1)], schema).write.parquet(src)
    out = str(tmp_path / "table")
    for step in range(2):
        if step:
            spark.createDataFrame([("n1", "new", 2)], schema).write.mode("append").parquet(src)
        ingest.upsert_nodes(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r["node_id"]: r["text"] for r in spark.read.parquet(out).collect()} == {"n1": "new", "n2": "x"}
    ments.write.parquet(str(tmp_path / "m"))
    w = ingest.windowed_mentions(ingest.first_mentions(spark.readStream.schema(ments.schema).parquet(str(tmp_path / "m"))))
    w.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start().awaitTermination()
