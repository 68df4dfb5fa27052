import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lodespark.config import EngineConfig
from lodespark.engine import BaselineEngine, Engine, read_results, results_table, token_table, write_results
from lodespark.functions import models
from lodespark.operators import evaluate, index

DOCS = [
    (1, "Albert Einstein published the theory of relativity. He was born in Ulm."),
    (2, "Marie Curie discovered radium in Paris. She won two Nobel Prizes."),
    (3, "Niels Bohr described the atom in Copenhagen."),
]
CONFIG = EngineConfig(dimension=256, chunk_mode="clean", initial_k=4, direct_chunk_k=2).with_chunking(256, 32)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "Where was Albert Einstein born?"), (2, "What did Marie Curie discover?"), (3, "")], "query_id long, question string")


@pytest.mark.parametrize("kind", [Engine, BaselineEngine])
def test_questions_are_answered_with_sources(spark, tmp_path, docs, questions, kind):
    engine = kind(spark, str(tmp_path / "ws"), CONFIG)
    traces, chunks = engine.index_documents(docs)
    assert chunks == 3 and (traces > 5 if kind is Engine else traces == 0) and engine.index_documents(docs) == (0, 0)
    rows = {r["query_id"]: r for r in engine.query(questions, 2).collect()}
    assert len(rows) == 3 and rows[1]["sources"][0]["doc_id"] == "1" and rows[2]["sources"][0]["doc_id"] == "2"
    if kind is Engine:
        assert rows[1]["answer"] == "Albert Einstein" and rows[2]["answer"] == "Marie Curie"
    else:
        assert rows[1]["answer"] == "NOT FOUND"
    assert engine.get_usage_stats()["questions"] == 3 and engine.get_usage_stats()["prompt_tokens"] > 0
    engine.reset_usage_stats()
    assert engine.get_usage_stats()["questions"] == 0


def test_empty_workspace(spark, tmp_path, questions):
    rows = Engine(spark, str(tmp_path / "none"), CONFIG).query(questions).collect()
    assert len(rows) == 3 and all(r["sources"] is None for r in rows)


def test_evaluation(spark, tmp_path, docs):
    engine = Engine(spark, str(tmp_path / "ws"), CONFIG)
    engine.index_documents(docs)
    points = spark.createDataFrame([("a", "Where was Albert Einstein born?", "Albert Einstein", ["Einstein"]), ("b", "What did Marie Curie discover?", "radium", None)], "id string, question string, ground_truth_answer string, ground_truth_aliases array<string>")
    told = engine.evaluate(points, [1, 3])
    write_results(told, str(tmp_path / "out"))
    assert read_results(spark, str(tmp_path / "out"), "id string, predicted_answer string").count() == 4
    swept = evaluate.sweep(evaluate.scored(told), ["exact_match", "f1_score"])
    assert {(r["top_k"], r["exact_match"]) for r in swept.collect()} == {(1, 0.5), (3, 0.5)}
    assert results_table(swept).where("exact_match = '0.5000'").count() == 2


def counting(dimension, log):
    """An embedder that writes a line for every text embedded, so that calls within tasks can be counted."""

    class Counting(models.HashEmbedder):
        def embed(self, texts):
            with open(str(log), "a") as out:
                out.writelines("x\n" for _ in texts)
            return super().embed(texts)

    return Counting(dimension), lambda: sum(1 for _ in open(log)) if os.path.exists(log) else 0


@pytest.mark.parametrize("kind", [Engine, BaselineEngine])
def test_indexed_rows_are_never_embedded_again(spark, tmp_path, docs, questions, kind):
    embedder, calls = counting(256, tmp_path / "log")
    engine = kind(spark, str(tmp_path / "ws"), CONFIG, embedder)
    engine.index_documents(docs)
    indexed = calls()
    assert indexed >= 3
    engine.query(questions).collect()
    engine.query(questions).collect()
    assert calls() - indexed <= 2 * 3
    vectors = engine.workspace.table("chunk_vectors")
    assert sorted(r["vec_id"] for r in vectors.collect()) == [0, 1, 2] and vectors.where("size(embedding) = 256").count() == 3
    with pytest.raises(Exception, match="needs 64 numbers"):
        engine.workspace.vectors("chunk_vectors", 64).collect()
    again = kind(spark, str(tmp_path / "ws"), CONFIG, embedder)
    assert {r["query_id"]: r["answer"] for r in again.query(questions, 2).collect()} == {r["query_id"]: r["answer"] for r in engine.query(questions, 2).collect()}


def test_numbers_go_on_and_stores_are_reset(spark, tmp_path, docs):
    engine = Engine(spark, str(tmp_path / "ws"), CONFIG)
    engine.index_documents(docs.where("doc_id = 1"))
    engine.index_documents(docs.where("doc_id > 1"))
    ids = [r["vec_id"] for r in engine.workspace.table("trace_vectors").collect()]
    assert sorted(ids) == list(range(len(ids))) and len(ids) == engine.workspace.table("traces").count()
    assert engine.workspace.table("traces").where("created_at is null").count() == 0
    before = engine.workspace.table("chunks").count()
    engine.save()
    assert engine.workspace.table("chunks").count() == before and len(engine.workspace.commits()) == 3
    engine.reset_trace_store()
    assert engine.workspace.table("traces").count() == 0 and engine.workspace.table("chunks").count() == before
    engine.reset_chunk_store()
    assert engine.workspace.table("chunks").count() == 0 and engine.index_documents(docs)[1] == 3


def test_retrieval_leaves_its_state(spark, tmp_path, docs, questions):
    engine = Engine(spark, str(tmp_path / "ws"), CONFIG)
    engine.index_documents(docs)
    engine.query(questions, 2).collect()
    traces = engine.workspace.current_traces()
    hits = traces.agg(F.sum("access_count")).first()[0]
    # Three questions, four nearest each, and all traces again around their mean.
    assert hits >= 3 * 4 and traces.where("access_count > 0 and last_accessed_at is null").count() == 0
    active = traces.where("status = 'active_in_stm'").count()
    assert active > 0 and engine.short_term_memory().count() == min(active, CONFIG.stm_capacity)
    one = traces.select("id").limit(1)
    count = engine.traces_by_id(one).first()["access_count"]
    assert engine.traces_by_id(one).first()["access_count"] == count + 1
    engine.update_trace_status(one, "dormant")
    assert engine.traces_by_id(one).first()["status"] == "dormant"
    assert engine.chunks_by_id(spark.createDataFrame([("1_chunk_0",)], "id string")).count() == 1
    quiet = Engine(spark, str(tmp_path / "ws"), CONFIG, record=False)
    before = quiet.workspace.table("accesses").count()
    quiet.query(questions).collect()
    assert quiet.workspace.table("accesses").count() == before


def test_a_broken_run_leaves_nothing(spark, tmp_path, docs, monkeypatch):
    engine = Engine(spark, str(tmp_path / "ws"), CONFIG)
    real = index.graph_edges
    monkeypatch.setattr(index, "graph_edges", lambda traces: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.index_documents(docs)
    monkeypatch.setattr(index, "graph_edges", real)

    # A run whose chunks are written but that dies before its commit.
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.workspace.commit({"chunks": docs.selectExpr("'1' source_doc_id", "0 chunk_idx", "'c' chunk_id", "0 start", "null title", "text chunk_text")})
    assert engine.workspace.table("chunks").count() == 0
    assert engine.index_documents(docs)[1] == 3 and engine.workspace.table("chunks").count() == 3
    assert engine.index_documents(docs.withColumn("text", F.concat("text", F.lit("!"))), batch="b")[1] == 3
    assert engine.index_documents(docs.withColumn("text", F.concat("text", F.lit("?"))), batch="b") == (0, 0)


def test_baseline_skips_by_id_and_replaces(spark, tmp_path, docs):
    engine = BaselineEngine(spark, str(tmp_path / "ws"), CONFIG)
    assert engine.index_documents(docs) == (0, 3)
    changed = docs.withColumn("text", F.concat("text", F.lit(" More.")))
    assert engine.index_documents(changed) == (0, 0)
    assert engine.index_documents(changed.where("doc_id = 1"), force=True) == (0, 1)
    chunks = engine.workspace.table("chunks")
    assert chunks.count() == 3 and chunks.where("chunk_text like '%More.'").count() == 1
    assert engine.workspace.table("chunk_vectors").count() == 3 and engine.workspace.table("traces").count() == 0


def test_extractor_prompts_and_reports(spark, tmp_path, docs):
    class Told:
        """Answers prompts for entities, compression and answers."""

        def complete(self, prompt):
            if prompt.startswith("List the entities"):
                return 'Here: [{"text": "Ulm", "type": "city", "importance_score": 4}, {"text": "Ulm", "type": "city", "importance_score": 4}]'
            if prompt.startswith("Keep of the passage"):
                return "short"
            return f"FINAL_ANSWER_TEXT: {'raw' if 'none' in prompt or 'Rest the answer' in prompt else 'plain'} {'short' if 'short' in prompt else 'long'}"

    engine = Engine(spark, str(tmp_path / "ws"), CONFIG, completer=Told(), extractor=models.PromptedExtractor(Told()))
    assert engine.index_documents(docs.withColumn("title", F.concat(F.lit("T"), "doc_id"))) == (3, 3)
    assert {(r["entity_text"], r["entity_type"]) for r in engine.workspace.table("traces").collect()} == {("Ulm", "LOC")}
    assert engine.workspace.table("chunks").where("title = 'T1'").count() == 1
    asked = spark.createDataFrame([(1, "Where was Albert Einstein born?")], "query_id long, question string")
    assert engine.query(asked).first()["answer"] == "plain long"
    raw = engine.query(asked, raw=True).first()
    assert raw["answer"] == "raw long" and [s["rank"] for s in raw["sources"]] == list(range(1, len(raw["sources"]) + 1))
    assert engine.query_cues(asked).first()["cues"] == ["Ulm"]
    points = spark.createDataFrame([("a", "Where was Albert Einstein born?", "plain long", None)], "id string, question string, ground_truth_answer string, ground_truth_aliases array<string>")
    swept = engine.run_evaluation(points, [1, 2], str(tmp_path / "out"))
    row = swept.where("top_k = 1").first()
    assert row["exact_match"] == 1.0 and row["rougeL"] == 1.0 and row["avg_processing_time"] > 0
    assert spark.read.json(str(tmp_path / "out/summary")).count() == 2 and spark.read.json(str(tmp_path / "out/analysis")).first()["total"] == 2
    assert spark.read.json(str(tmp_path / "out/usage")).where("name = 'query_calls' and value >= 4").count() == 1
    assert token_table(engine.usage_rows()).count() == 6 and read_results(spark, str(tmp_path / "nowhere")).count() == 0
    wide = evaluate.wide_results(evaluate.long_results(swept, ["exact_match", "rougeL"]), ["exact_match", "rougeL"])
    assert wide.count() == 2 and wide.where("rougeL = 1").count() == 2


def test_whole_graph_documents(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "ws"), CONFIG)
    engine.index_documents(spark.createDataFrame([(1, 'Anna <Bell> met "Carl" & Dora\x01.'), (2, "Nobody Else.")], "doc_id long, text string"))
    nodes, edges = engine.workspace.graph()
    engine.save_knowledge_graph_json(str(tmp_path / "json"))
    read = lambda form: "\n".join(p.read_text() for p in sorted((tmp_path / form).glob("part-*")))
    graph = json.loads(read("json"))
    assert len(graph["nodes"]) == nodes.count() and len(graph["edges"]) == edges.count() and {"id", "type", "text", "metadata"} <= graph["nodes"][0].keys()
    engine.workspace.export_graph(str(tmp_path / "xml"), "graphml")
    root = ElementTree.fromstring(read("xml"))
    assert len(root.findall(".//{*}node")) == nodes.count() and len(root.findall(".//{*}edge")) == edges.count()
    empty = Engine(spark, str(tmp_path / "none"), CONFIG)
    empty.save_knowledge_graph_json(str(tmp_path / "json0"))
    assert json.loads(read("json0")) == {"nodes": [], "edges": []}
