"""Queries of retrieval, indexing, answering and evaluation, over whole tables.

Searches take as queries every vector whose id is divisible by 20, against all vectors.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.config import EngineConfig
from lodespark.engine import BaselineEngine, Engine
from lodespark.functions import metrics, models
from lodespark.functions import text as T
from lodespark.functions.vectors import centroid, nearest
from lodespark.operators import answer, chunking, evaluate, index, retrieve
from lodespark.session import checkpoint_dir, table
from lodespark.sources import datasets

CONFIG = EngineConfig(dimension=64)
CHUNKED = CONFIG.with_chunking(512, 128)
STATUSES = ["dormant", "active_in_stm"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("archived"), F.lit("dormant"), F.lit("active_in_stm")), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", status.alias("status"))


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _chunk_of(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.concat(F.lit("chunk_"), (F.col("vec_id") % 100).cast("string")).alias("chunk_id"))


def _chunk_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of every chunk: the mean of the vectors of its traces, under the chunk's number."""
    return centroid(vectors.withColumn("chunk", F.col("vec_id") % 100), "chunk", "embedding").select(F.col("chunk").alias("vec_id"), F.col("centroid").alias("embedding"))


def _neat(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 6))


def n1_trace_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _neat(nearest(_asked(vectors), vectors, CONFIG.initial_k))


def n1_knn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _neat(retrieve.with_status(_asked(vectors), vectors, 10, STATUSES, CONFIG.overfetch))


def n2_chunk_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _neat(nearest(_asked(vectors), vectors, 5)).join(_chunk_of(vectors), "vec_id").select("query_id", "rank", "chunk_id", "distance")


def n3_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sequenced(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


def n4_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    seeds = nearest(_asked(vectors), vectors, CONFIG.seed_limit).join(vectors.select("vec_id", "embedding"), "vec_id")
    return centroid(seeds, "query_id", "embedding").select("query_id", F.posexplode("centroid").alias("pos", "value")).select("query_id", "pos", F.round("value", 6).alias("value"))


def n5_cosine_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = nearest(_asked(vectors), vectors, CONFIG.initial_k).withColumnRenamed("rank", "discovery")
    return retrieve.rerank(found, _asked(vectors), vectors, 5).withColumn("similarity", F.round("similarity", 6))


def n6_associative(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = retrieve.associative(_asked(vectors), vectors, CONFIG)
    return retrieve.rerank(found, _asked(vectors), vectors, CONFIG.final_k).withColumn("similarity", F.round("similarity", 6))


def n6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieve.associative(_asked(vectors), vectors, CONFIG).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))


def n7_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieve.hybrid(_asked(vectors), vectors, _chunk_vectors(vectors), _chunk_of(vectors), 5)


def n8_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "title")
    return nearest(_asked(vectors), vectors, 5).join(docs, "vec_id").select("query_id", "rank", F.col("vec_id").alias("doc_id"), "title")


def u1_chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = nearest(_asked(vectors), vectors, CONFIG.initial_k)
    direct = nearest(_asked(vectors), _chunk_vectors(vectors), CONFIG.direct_chunk_k).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("vec_id").cast("string")))
    return retrieve.chunk_list(found, direct, _chunk_of(vectors), CONFIG.chunk_limit)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["chunk_id", "title", "chunk_text", "source_doc_id"]
    return table(spark, sf_dir, "chunk_metadata").select(*columns).unionByName(table(spark, sf_dir, "pinned_chunks").select(*columns)).dropDuplicates(["chunk_id"])


def j1_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A few chunks hold most mentions: they are counted before the join, so that no key is hot in it.
    counted = table(spark, sf_dir, "traces").where(F.col("source_chunk_id").isNotNull()).groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("mentions"))
    return counted.join(_chunks(spark, sf_dir), "chunk_id").select("chunk_id", "title", "mentions")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 != 0)
    return index.manifest_of(docs.withColumn("text", F.when(F.col("doc_id") % 6 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))))


def j3_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.new_documents(index.valid_documents(table(spark, sf_dir, "documents")), _manifest(spark, sf_dir)).select("doc_id", F.md5("text").alias("content_md5"))


def j3_new_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.new_documents(table(spark, sf_dir, "documents"), _manifest(spark, sf_dir), by_content=False).select("doc_id")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").dropDuplicates(["prediction_id"])


def j6_gold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = metrics.gold_answers(F.col("ground_truth_answer"), F.col("ground_truth_aliases"))
    return _predictions(spark, sf_dir).select("prediction_id", F.array_join(golds, "|").alias("golds"))


def j7_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = table(spark, sf_dir, "traces")
    # One row: the id looked up.
    wanted = traces.agg(F.min("id").alias("id"))
    return traces.join(F.broadcast(wanted), "id").select("id", "entity_text", "source_chunk_id").distinct()


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    traces = table(spark, sf_dir, "traces")
    return index.graph_nodes(traces, _chunks(spark, sf_dir)).select("id", "type", "text"), index.graph_edges(traces).distinct()


def k4_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


def k4_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def a10_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")))


def d9_valid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.valid_documents(table(spark, sf_dir, "documents")).select("doc_id")


def d11_chunks_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", CHUNKED)
    return rows.select("source_doc_id", "chunk_idx", "start", F.md5("chunk_text").alias("digest"))


def d11_chunks_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    rows = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", replace(CHUNKED, chunk_mode="clean"))
    return rows.select("source_doc_id", "chunk_idx", "start", F.md5("chunk_text").alias("digest"))


def d13_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    rows = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", replace(CONFIG, enable_chunking=False))
    return rows.select("source_doc_id", "chunk_id", F.length("chunk_text").alias("n_chars"))


def d14_recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", CHUNKED, "recursive")
    return rows.select("source_doc_id", "chunk_id", F.length("chunk_text").alias("n_chars"))


def d16_entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "traces").where(F.col("entity_text").isNotNull()).select("id", T.entity_text(F.col("entity_text"), F.col("entity_description")).alias("embed_text"))


def d17_trace_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_defaults(table(spark, sf_dir, "traces").select("id", "entity_text", "entity_type", "entity_description", "entity_importance", "status", "access_count"))


def d19_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.md5(F.substring("text", 1, n))
    return table(spark, sf_dir, "documents").select("doc_id", part(models.EMBED_CHARS).alias("embed_md5"), part(models.EXTRACT_CHARS).alias("extract_md5"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("prediction_id", F.posexplode("sources").alias("pos", "s")).select("prediction_id", "pos", "s.doc_id", "s.chunk_id", "s.title")


def d20_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _chunks(spark, sf_dir).select("chunk_id", F.col("chunk_text").alias("text"))
    rows = _sources(spark, sf_dir).join(texts, "chunk_id", "left")
    passages = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "doc_id", "title", "text")))
    return rows.groupBy("prediction_id").agg(passages.alias("c")).select("prediction_id", F.md5(answer.passage_blocks(F.col("c"), raw=True)).alias("context_md5"))


def d22_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def u4_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(spark, sf_dir).where(F.col("doc_id") != "")
    return answer.citations(rows, "prediction_id", "doc_id", "pos").select("prediction_id", "pos", "doc_id", "chunk_id")


def f1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("prediction_id", T.normalize(F.col("predicted_answer")).alias("predicted"), T.normalize(F.col("ground_truth_answer")).alias("gold"))


def f2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("tokens"), T.word_count(F.col("text")).alias("words"), answer.too_long(F.col("text")).alias("too_long"))


def f4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.scored(table(spark, sf_dir, "predictions"))
    return rows.select("prediction_id", F.col("m_exact_match").alias("em"), F.round("m_f1_score", 6).alias("f1"))


def f5_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = metrics.gold_answers(F.col("ground_truth_answer"), F.col("ground_truth_aliases"))
    return _predictions(spark, sf_dir).select("prediction_id", metrics.rouge_scores(F.col("predicted_answer"), golds).alias("r")).select("prediction_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


def f7_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.md5_hex(F.col("text")).alias("digest"), T.token_estimate(F.col("text")).alias("tokens"))


def f11_salvaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.to_json(F.struct(F.col("entity_text").alias("text"), F.col("entity_type").alias("type"), F.col("entity_description").alias("description"), F.col("entity_importance").alias("importance_score")))
    response = F.concat(F.lit("Sure, here they are:\n["), item, F.lit(', "stray"]\nDone.'))
    rows = table(spark, sf_dir, "traces").select("id", F.explode(T.salvage_json(response)).alias("e"))
    return rows.select("id", "e.text", "e.type", "e.description", "e.importance_score")


def f13_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = F.concat(F.lit("- "), F.col("entity_text"))
    return table(spark, sf_dir, "traces").where(F.col("entity_text") != "").select("id", F.array_join(T.tolerant_entities(response), "|").alias("found"))


def f14_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "traces").select("entity_type", T.canonical_type(F.col("entity_type")).alias("canonical")).groupBy("entity_type", "canonical").agg(F.count(F.lit(1)).alias("n"))


def f15_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("entity_importance").cast("decimal(20,2)").cast("string")
    return table(spark, sf_dir, "traces").select(raw.alias("raw"), T.canonical_importance(raw).alias("score")).groupBy("raw", "score").agg(F.count(F.lit(1)).alias("n"))


def f16_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("prediction_id", T.parse_answer(F.col("predicted_answer")).alias("answer"))


def l4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 131).select(F.col("id").alias("top_k"), T.chunk_budget(F.col("id")).cast("int").alias("budget"))


def l6_first_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("prediction_id", "run_id").orderBy("prediction_id").limit(100)


def a1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(evaluate.scored(table(spark, sf_dir, "predictions")), ["exact_match", "f1_score"])


def a2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_usage(_predictions(spark, sf_dir))


def a6_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "samples").dropDuplicates(["id"]).select("id", F.transform("supporting_facts", lambda f: f["title"]).alias("relevant"))
    rows = _predictions(spark, sf_dir).select("prediction_id", "id", F.transform("sources", lambda s: s["title"]).alias("retrieved")).join(gold, "id", "left")
    scored = rows.select("prediction_id", metrics.retrieval_prf(F.filter("retrieved", lambda t: t.isNotNull()), F.filter("relevant", lambda t: t.isNotNull()), 3).alias("m"))
    return scored.select("prediction_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def a7_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.analysis(evaluate.scored(table(spark, sf_dir, "predictions")))


def a7_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.extremes(evaluate.scored(table(spark, sf_dir, "predictions")))


def a8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.scored(table(spark, sf_dir, "predictions"))
    swept = rows.groupBy("run_id", "top_k").agg(F.round(F.avg("m_f1_score"), 6).alias("f1"), F.round(F.avg("m_exact_match"), 6).alias("em"))
    return swept.unpivot(["run_id", "top_k"], ["f1", "em"], "metric", "value")


def t1_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieve.access_log(nearest(_asked(vectors), vectors, CONFIG.initial_k))


def t2_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = retrieve.associative(_asked(vectors), vectors, CONFIG).where(F.col("discovery") > CONFIG.initial_k)
    return retrieve.statuses(found, vectors.select("vec_id"))


def t3_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.short_term_memory(table(spark, sf_dir, "traces").where(F.col("source_doc_id").isNotNull() & F.col("last_accessed_at").isNotNull()), "source_doc_id", "id", "last_accessed_at", CONFIG.stm_capacity)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "samples").dropDuplicates(["id"])
    parts = [datasets.data_points(samples.where(F.col("dataset") == d), d) for d in ("hotpotqa", "2wiki", "musique")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def s4_data_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", "question", F.size("contexts").alias("contexts"), "ground_truth_answer", F.size("ground_truth_aliases").alias("aliases"))


def d6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.documents_for_indexing(_points(spark, sf_dir))


def d7_question_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.question_documents(_points(spark, sf_dir)).select("id", F.array_join("doc_ids", "|").alias("doc_ids"))


def d3_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").dropDuplicates(["id"]).select("id", T.hop(F.col("id")).alias("hop"))


def _raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "samples").dropDuplicates(["id"]).where(F.col("dataset") != "musique")
    context = F.transform("chunks", lambda c: F.array(F.coalesce(c["title"], F.lit("")), F.to_json(F.array(F.coalesce(c["chunk"], F.lit("")), F.lit("End.")))))
    facts = F.transform("supporting_facts", lambda f: F.array(F.coalesce(f["title"], F.lit("")), F.lit("0")))
    evidences = F.transform("evidences", lambda e: F.array(e["subject"], e["relation"], e["object"]))
    return rows.select(F.col("id").alias("_id"), "type", "question", "answer", context.alias("context"), facts.alias("supporting_facts"), evidences.alias("evidences"))


def d1_pair_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.normalize_pairs(_raw_pairs(spark, sf_dir), with_evidences=True)
    return rows.select("hop", F.explode("chunks").alias("c")).select("hop", "c.id", "c.title", F.md5("c.chunk").alias("digest"))


def d5_supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.normalize_pairs(_raw_pairs(spark, sf_dir))
    return rows.select("id", F.explode("supporting_facts").alias("f")).select("id", F.col("f.id").alias("chunk_id"))


def d4_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.normalize_pairs(_raw_pairs(spark, sf_dir), with_evidences=True)
    return rows.select("id", F.posexplode("evidences").alias("pos", "e")).select("id", "pos", "e.subject", "e.relation", "e.object")


def d2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "samples").dropDuplicates(["id"]).where(F.col("dataset") == "musique")
    paragraphs = F.transform("chunks", lambda c, i: F.struct(i.alias("idx"), c["title"].alias("title"), c["chunk"].alias("paragraph_text"), (i % 2 == 0).alias("is_supporting")))
    steps = F.transform("decomposition", lambda d: F.struct(d["id"].cast("string").alias("id"), d["question"].alias("question"), d["answer"].alias("answer")))
    raw = rows.select("id", F.when(F.col("hop") == 4, F.lit(False)).alias("answerable"), "question", "answer", "answer_aliases", paragraphs.alias("paragraphs"), steps.alias("question_decomposition"))
    samples = datasets.normalize_paragraphs(raw)
    return samples.select("hop", F.explode("supporting_facts").alias("f")).select("hop", "f.id", "f.title")


def x2_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "traces").where(F.col("entity_text").isNotNull()).select("entity_text").distinct()
    rows = models.embed_texts(texts, "entity_text", models.HashEmbedder(64)).select("entity_text", F.posexplode("embedding").alias("pos", "value"))
    return rows.where(F.col("value") != 0).select("entity_text", "pos", F.round(F.col("value").cast("double"), 4).alias("value"))


def _extracted(text: F.Column, docs: DataFrame) -> DataFrame:
    rows = docs.select(F.explode(models.extract_entities(text)).alias("e"))
    return rows.groupBy(F.col("e.text").alias("entity"), F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("documents"))


def x6_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(F.col("text"), table(spark, sf_dir, "documents"))


def t0_index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    parts = index.index_documents(table(spark, sf_dir, "documents"), _manifest(spark, sf_dir), replace(CHUNKED, chunk_mode="clean"))
    counted = [parts[n].agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows")) for n in ("chunks", "traces", "edges", "manifest")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def x8_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    ranked = n6_associative(spark, sf_dir)
    entity = F.struct("rank", F.concat(F.lit("entity "), F.col("vec_id").cast("string")).alias("text"), F.element_at(F.array(*[F.lit(t) for t in T.TYPES]), (F.col("label") + 1).cast("int")).alias("type"), F.lit("").alias("description"))
    rows = ranked.join(vectors.select("vec_id", "label"), "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    passage = F.struct("rank", "chunk_id", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("Text of "), "chunk_id").alias("text"), F.lit(0.5).alias("similarity"))
    passages = u1_chunk_list(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(passage)).alias("chunks"))
    asked = F.concat(F.lit("What is vector "), F.col("query_id").cast("string"), F.lit("?"))
    told = rows.join(passages, "query_id").select("query_id", answer.prompt(asked, F.col("entities"), F.col("chunks")).alias("prompt"))
    return answer.answer(told).select("query_id", "answer", F.size(F.split("prompt", "Passage [0-9]+ ")).alias("parts"))


def _indexed(spark: SparkSession, sf_dir: str, kind: type[Engine]) -> DataFrame:
    """(part, rows): the tables of a new workspace, in the shared folder, that an engine has indexed all documents into."""
    from dataclasses import replace

    engine = kind(spark, f"{checkpoint_dir(spark)}/workspace-{uuid.uuid4().hex}", replace(CONFIG, enable_chunking=False))
    engine.index_documents(table(spark, sf_dir, "documents"))
    names = ("chunks", "traces", "edges", "manifest", "trace_vectors", "chunk_vectors") if kind is Engine else ("chunks", "manifest", "chunk_vectors")
    counted = [engine.workspace.table(n).agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows")) for n in names]
    return functools.reduce(DataFrame.unionByName, counted)


def t0_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, Engine)


def t0_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without chunking the splitter leaves documents whole in both engines.
    return _indexed(spark, sf_dir, BaselineEngine)


def u4_citations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(spark, sf_dir).where(F.col("doc_id") != "").select("prediction_id", F.col("doc_id").alias("source_doc_id"), F.col("pos").alias("rank"), "chunk_id")
    # The first two sources stand as chunks, all as sources of entities.
    return answer.citations_with_entities(rows.where(F.col("rank") < 2), rows, "prediction_id").select("prediction_id", "source_doc_id", "chunk_id", "rank")


def a8_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = evaluate.sweep(evaluate.scored(table(spark, sf_dir, "predictions")), ["exact_match", "f1_score"])
    return evaluate.wide_results(evaluate.long_results(swept, ["exact_match", "f1_score"]), ["exact_match", "f1_score"])


def f20_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = models.query_cues(_predictions(spark, sf_dir), "question")
    return cues.select("prediction_id", F.array_join("cues", "|").alias("cues"))


_ALL = (
    n1_trace_knn, n1_knn_status, n2_chunk_knn, n3_sequence, n4_centroid, n5_cosine_rerank, n6_associative, n6_candidates, n7_hybrid, n8_baseline, u1_chunk_list, j1_mentions, j3_new_documents,
    j3_new_by_id, j6_gold_answers, j7_lookup, k4_graph_nodes, k4_graph_edges, a10_graph_counts, d9_valid_documents, d11_chunks_compat, d11_chunks_clean, d13_whole_documents, d14_recursive_chunks,
    d16_entity_text, d17_trace_defaults, d19_truncated, d20_contexts, d22_previews, u4_citations, f1_normalized, f2_token_counts, f4_scores, f5_rouge, f7_digests, f11_salvaged, f13_tolerant, f14_types,
    f15_importance, f16_answers, l4_budget, l6_first_predictions, a1_sweep, a2_tokens, a6_retrieval, a7_analysis, a7_extremes, a8_runs, t1_accesses, t2_statuses, t3_memory, s4_data_points, d6_documents,
    d7_question_documents, d3_hops, d1_pair_chunks, d5_supporting, d4_evidences, d2_paragraphs, x2_embedded, x6_extracted, t0_index_sizes, x8_answers, t0_engine, t0_baseline, u4_citations_raw, a8_wide, f20_cues,
)
QUERIES = {f.__name__: f for f in _ALL}
