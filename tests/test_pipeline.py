import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.config import EngineConfig
from lodespark.operators import answer, chunking, evaluate, index, retrieve
from lodespark.sources import datasets
from lodespark.sources.workspace import Workspace, graphml_rows
from lodespark.streaming.incremental import index_stream

CLEAN = EngineConfig(chunk_mode="clean").with_chunking(60, 10)


def test_clamps():
    c = EngineConfig().with_chunking(10, 40)
    assert (c.chunk_size, c.chunk_overlap) == (50, 25)


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (128, 128), (129, 129), (512, 129)])
def test_compat_tail(n, chunks):
    assert len(chunking.sliding_spans("x" * n, 512, 128)) == chunks


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(50, 90), st.integers(0, 25))
@settings(max_examples=60, deadline=None)
def test_sliding_covers_the_text(text, size, overlap):
    for mode in ("compat", "clean"):
        spans = chunking.sliding_spans(text, size, overlap, mode)
        assert all(0 < e - s <= size for s, e in spans)
        assert not text or (spans[0][0] == 0 and max(e for _, e in spans) == len(text))
        assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))


@given(st.text(alphabet="abc \n", max_size=300), st.integers(20, 60))
@settings(max_examples=60, deadline=None)
def test_recursive_pieces_fit(text, size):
    pieces = chunking.recursive_split(text, size, size // 4)
    assert all(p == p.strip() and 0 < len(p) <= size for p in pieces)
    assert set("".join(pieces)) >= set(text) - set(" \n")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string")


def test_index_is_incremental(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    assert ws.table("chunks").count() == 0
    first = docs(spark, [(1, "Anna Bell met Carl Dorn in Essen.", ""), (2, "", ""), (3, None, ""), (None, "Nobody here", "")])
    traces, chunks = ws.index(first, CLEAN)
    assert chunks == 1 and traces == 3
    assert ws.index(first, CLEAN) == (0, 0)
    changed = docs(spark, [(1, "Anna Bell left.", ""), (4, "New Text", "")])
    assert ws.index(changed, CLEAN)[1] == 2
    assert ws.table("manifest").count() == 3
    assert ws.index(changed, CLEAN, force=True)[1] == 2 and ws.table("chunks").count() == 2
    nodes, edges = ws.graph()
    assert edges.join(nodes, edges["target"] == nodes["id"]).count() == edges.count() > 0
    assert graphml_rows(nodes, edges).count() == nodes.count() + edges.count()
    ws.export_graph_json(str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/nodes")).count() == nodes.count()


def test_stream_adds_once(spark, tmp_path):
    source = tmp_path / "in"
    docs(spark, [(1, "Anna Bell.", ""), (2, "Carl Dorn.", "")]).write.parquet(str(source))
    ws = Workspace(spark, str(tmp_path / "ws"))
    for run in ("a", "b"):
        stream = spark.readStream.schema("doc_id long, text string, extra string").parquet(str(source))
        index_stream(stream, ws, CLEAN, str(tmp_path / run)).awaitTermination()
    assert ws.table("chunks").count() == 2


def test_no_manifest_matches_by_content(spark):
    d = docs(spark, [(1, "a", ""), (2, "b", "")])
    m = spark.createDataFrame([("1", "wrong")], "doc_id string, content_md5 string")
    assert index.new_documents(d, m).count() == 2
    assert [r["doc_id"] for r in index.new_documents(d, m, by_content=False).collect()] == [2]


def test_sequence(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(200)], "k long").repartition(7)
    got = {r["k"]: r["seq"] for r in index.sequenced(df, "k").collect()}
    assert got == {i * 3: i for i in range(200)}
    assert index.sequenced(df.limit(0), "k").count() == 0


def test_depth_and_weighting(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(100)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = corpus.where("vec_id < 3").toDF("query_id", "query_vector")
    for depth, weighting in ((0, "uniform"), (1, "uniform"), (2, "similarity")):
        found = retrieve.associative(asked, corpus, EngineConfig(initial_k=12, depth=depth, weighting=weighting))
        per = [r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d")).where("n = d").collect()]
        assert len(per) == 3 and min(per) >= 12


def test_hotpot_fixture(spark, tmp_path):
    raw = [{"_id": "s", "type": "bridge", "question": "q", "answer": "a", "context": [["T", ["x.", "y."]], ["U", ["z."]], ["T", ["last."]]], "supporting_facts": [["T", 0], ["U", 1], ["T", 1], ["gone", 0]], "evidences": [["a", "b", "c"], ["a", "b"]]}]
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    row = datasets.normalize_pairs(datasets.read_pairs(spark, str(tmp_path / "raw.json")), True).first()
    assert [tuple(c) for c in row["chunks"]] == [("s_ctxchunk_0", "T", "T: x. y."), ("s_ctxchunk_1", "U", "U: z."), ("s_ctxchunk_2", "T", "T: last.")]
    assert [c["id"] for c in row["supporting_facts"]] == ["s_ctxchunk_2", "s_ctxchunk_1"]
    assert [tuple(e) for e in row["evidences"]] == [("a", "b", "c")] and row["hop"] == 2


def test_musique_fixture(spark, tmp_path):
    raw = [{"id": "3hop__1", "question": "q", "answer": "a", "paragraphs": [{"idx": 4, "title": "T", "paragraph_text": "x", "is_supporting": True}, {"title": "U", "paragraph_text": "y"}]}, {"id": "2hop__2", "answerable": False}]
    (tmp_path / "raw.jsonl").write_text("\n".join(map(json.dumps, raw)))
    rows = datasets.normalize_paragraphs(datasets.read_paragraphs(spark, str(tmp_path / "raw.jsonl"))).collect()
    assert len(rows) == 1 and rows[0]["hop"] == 3
    assert [c["id"] for c in rows[0]["chunks"]] == ["3hop__1_chunk_4", "3hop__1_chunk_1"]
    assert [c["id"] for c in rows[0]["supporting_facts"]] == ["3hop__1_sf_chunk_4"]
    datasets.write_samples(spark.createDataFrame(rows, datasets.normalize_paragraphs(datasets.read_paragraphs(spark, str(tmp_path / "raw.jsonl"))).schema), str(tmp_path / "out"))
    assert datasets.read_samples(spark, str(tmp_path / "out")).count() == 1


def test_prompts(spark):
    entities = F.array(F.struct(F.lit("Ann").alias("text"), F.lit("PERSON").alias("type"), F.lit("d").alias("description")))
    none_e = F.filter(entities, lambda e: F.lit(False))
    chunk = F.array(F.struct(F.lit("c").alias("chunk_id"), F.lit(None).cast("string").alias("doc_id"), F.lit("t").alias("title"), F.lit("body").alias("text"), F.lit(0.256).alias("similarity")))
    none_c = F.filter(chunk, lambda c: F.lit(False))
    row = spark.range(1).select(answer.prompt(F.lit("Q?"), entities, chunk).alias("both"), answer.prompt(F.lit("Q?"), none_e, none_c).alias("none"), answer.passage_blocks(chunk).alias("plain"), answer.passage_blocks(chunk, True).alias("raw")).first()
    assert "1. Ann (Type: PERSON): d" in row["both"] and "Passages:" in row["both"]
    assert row["none"] == answer.NO_CONTEXT + "Q?"
    assert row["plain"] == "Passage 1 (Relevance: 0.26):\nbody"
    assert row["raw"] == "Passage 1 (ID: c, From Document: unknown, Title: t):\nbody"


def test_plug_in_metric(spark):
    df = spark.createDataFrame([(1, "r", 5, "q", "yes", "yes", ["yes"], 1.0), (1, "r", 5, "q", "yes", "yes", ["yes"], 1.0), (2, "r", 5, "q", None, "no", None, None)], "prediction_id long, run_id string, top_k int, question string, predicted_answer string, ground_truth_answer string, ground_truth_aliases array<string>, processing_time double")
    rows = evaluate.scored(df, {**evaluate.METRICS, "length": lambda p, g: F.length(p).cast("double")})
    swept = evaluate.sweep(rows, ["exact_match", "f1_score", "length"]).first()
    assert (swept["questions"], swept["exact_match"], swept["length"], swept["avg_processing_time"]) == (2, 0.5, 1.5, 0.5)
    assert evaluate.long_results(evaluate.sweep(rows, ["exact_match"]), ["exact_match"]).count() == 1
