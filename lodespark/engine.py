"""The engine: index documents into a workspace and answer questions from it, many at once."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark import schemas
from lodespark.config import EngineConfig
from lodespark.functions import models
from lodespark.functions import text as T
from lodespark.functions.vectors import cosine, nearest
from lodespark.operators import answer, evaluate, index, retrieve
from lodespark.session import cut
from lodespark.sources.workspace import Workspace

_ENTITY = "array<struct<rank:int,text:string,type:string,description:string,similarity:double>>"
_CHUNK = "array<struct<rank:int,chunk_id:string,doc_id:string,title:string,text:string,similarity:double>>"


class Engine:
    """Associative retrieval: questions find entity traces, traces lead to chunks and to further traces.

    Vectors are stored by ``index_documents`` in tables of their own and numbered there, so that a query embeds the
    questions only and queries without a vector search never read vectors. Every retrieval is recorded: each hit of a
    search as an access, each newly associated trace as active; status, access counts and the short-term memory follow
    from these logs (``record=False`` leaves them out).
    """

    def __init__(
        self, spark: SparkSession, path: str, config: EngineConfig | None = None, embedder: models.Embedder | None = None, completer: models.Completer | None = None,
        extractor: models.Extractor | None = None, record: bool = True,
    ) -> None:
        self.spark, self.config, self.record = spark, config or EngineConfig(dimension=64), record
        self.embedder = embedder or models.HashEmbedder(self.config.dimension)
        self.completer = completer or models.EchoCompleter()
        self.extractor = extractor
        self.workspace = Workspace(spark, path)
        self.reset_usage_stats()

    def reset_usage_stats(self) -> None:
        self.usage = {
            "indexing_seconds": 0.0, "query_seconds": 0.0, "indexing_calls": 0, "query_calls": 0, "indexed_traces": 0, "indexed_chunks": 0, "questions": 0,
            "embedding_tokens": 0, "prompt_tokens": 0, "answer_tokens": 0,
        }

    def get_usage_stats(self) -> dict[str, float | dict[str, float]]:
        """All counters by name and, in parts, tokens, seconds, numbers of operations and, of a caching embedder on this driver, its hits and misses."""
        u = self.usage
        cache = self.embedder.stats() if hasattr(self.embedder, "stats") else {}
        per_question = {name: u[name] / u["questions"] if u["questions"] else 0.0 for name in ("query_seconds", "prompt_tokens", "answer_tokens")}
        return {
            **u, "token_usage": {n: u[n] for n in ("embedding_tokens", "prompt_tokens", "answer_tokens")}, "timing": {n: u[n] for n in ("indexing_seconds", "query_seconds")},
            "operations": {n: u[n] for n in ("indexing_calls", "query_calls", "indexed_traces", "indexed_chunks", "questions")}, "embedding_cache": cache, "per_question": per_question,
        }

    def usage_rows(self) -> DataFrame:
        """(part, name, value): the usage as a table, as it is written beside results."""
        rows = [(part, name, float(value)) for part, held in self.get_usage_stats().items() if isinstance(held, dict) for name, value in held.items()]
        return self.spark.createDataFrame(rows, "part string, name string, value double")

    def index_documents(self, docs: DataFrame, force: bool = False, key: str = "doc_id", text: str = "text", batch: str | None = None) -> tuple[int, int]:
        """Indexes new and changed documents; returns the numbers of traces and chunks added."""
        began = time.perf_counter()
        added = self._index(docs, force, key, text, batch)
        for name, value in (("indexing_seconds", time.perf_counter() - began), ("indexing_calls", 1), ("indexed_traces", added[0]), ("indexed_chunks", added[1])):
            self.usage[name] += value
        return added

    def _index(self, docs: DataFrame, force: bool, key: str, text: str, batch: str | None) -> tuple[int, int]:
        return self.workspace.index(docs, self.config, force, key, text, self.embedder, self.extractor, batch)

    def reset(self) -> None:
        self.workspace.reset()

    def reset_trace_store(self) -> None:
        self.workspace.reset(*schemas.TRACE_STORE)

    def reset_chunk_store(self) -> None:
        self.workspace.reset(*schemas.CHUNK_STORE)

    def save(self) -> None:
        """Makes one batch of all that was committed; every commit is saved already."""
        self.workspace.compact()

    def save_knowledge_graph_json(self, path: str) -> None:
        self.workspace.export_graph(path, "json")

    def traces_by_id(self, ids: DataFrame) -> DataFrame:
        """The traces of the ids asked for (a column ``id``); each counts as accessed."""
        found = index.lookup(self.workspace.current_traces(), ids)
        self._log("accesses", index.lookup(self.workspace.table("traces"), ids).select("id").distinct())
        return found

    def chunks_by_id(self, ids: DataFrame) -> DataFrame:
        """The chunks of the ids asked for (a column ``id``)."""
        return index.lookup(self.workspace.table("chunks"), ids, "chunk_id")

    def update_trace_status(self, ids: DataFrame, status: str) -> None:
        """Gives the traces of the ids asked for (a column ``id``) a status."""
        known = index.lookup(self.workspace.table("traces"), ids).select("id").distinct()
        self.workspace.commit({"activations": known.select("id", F.lit(status).alias("status"), F.current_timestamp().alias("at"))})

    def _log(self, name: str, ids: DataFrame, status: str | None = None) -> None:
        if self.record:
            told = [] if status is None else [F.lit(status).alias("status")]
            self.workspace.commit({name: ids.select("id", *told, F.current_timestamp().alias("at"))})

    def short_term_memory(self) -> DataFrame:
        """(id, seq): the traces last activated, as many as the memory holds, by their first activation."""
        log = self.workspace.table("activations").where(F.col("status") == "active_in_stm").withColumn("session", F.lit(0))
        return retrieve.short_term_memory(log, "session", "id", "at", self.config.stm_capacity).select("id", "seq")

    def query_cues(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, cues): the entities that questions name."""
        return models.query_cues(questions, "question", self.extractor)

    def _asked(self, questions: DataFrame) -> DataFrame:
        given = questions.select(F.col("query_id").cast("bigint").alias("query_id"), "question")
        return cut(models.embed_texts(given, "question", self.embedder, "query_vector"))

    def retrieve(self, questions: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(entities, chunks) of questions (query_id, question): entities reranked, chunks in the order of discovery."""
        k = self.config.final_k if top_k is None else top_k
        traces, chunks = self.workspace.table("traces"), self.workspace.table("chunks")
        asked = self._asked(questions)
        queries = asked.select("query_id", "query_vector")
        vectors, passages = (self.workspace.vectors(name, self.embedder.dimension) for name in ("trace_vectors", "chunk_vectors"))
        found, hits = retrieve.associative_hits(queries, vectors.select("vec_id", "embedding"), self.config)
        found = cut(found)
        keyed = traces.join(vectors.select("vec_id", "id"), "id").select("vec_id", "id", "entity_text", "entity_type", "entity_description", F.col("source_chunk_id").alias("chunk_id"), "source_doc_id")
        if self.record:
            new = found.where(F.col("discovery") > self.config.initial_k).select("vec_id").distinct()
            self._log("accesses", hits.join(vectors.select("vec_id", "id"), "vec_id"))
            self._log("activations", new.join(vectors.select("vec_id", "id"), "vec_id"), "active_in_stm")
        ranked = retrieve.rerank(found, queries, vectors.select("vec_id", "embedding"), k).join(keyed, "vec_id")
        direct = nearest(queries, passages, min(self.config.direct_chunk_k, self.config.initial_k)).join(passages.select("vec_id", F.col("id").alias("chunk_id")), "vec_id")
        initial = found.where(F.col("discovery") <= self.config.initial_k).select("query_id", F.col("discovery").alias("rank"), "vec_id")
        if self.config.hybrid:
            initial = initial.where(F.col("rank") <= k)
        listed = retrieve.chunk_list(initial, direct, keyed.select("vec_id", "chunk_id"), self.config.chunk_limit)
        return ranked, self._passages(listed, chunks, passages, queries)

    def _passages(self, listed: DataFrame, chunks: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
        """Listed chunks with their texts and their similarity to the question."""
        near = listed.join(chunks, "chunk_id").join(passages.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id", "left").join(queries, "query_id")
        return near.withColumn("similarity", cosine(F.col("embedding"), F.col("query_vector"))).drop("embedding", "query_vector")

    def query(self, questions: DataFrame, top_k: int | None = None, raw: bool = False, compress: bool = False) -> DataFrame:
        """(query_id, question, answer, sources) of questions (query_id, question).

        ``raw`` asks with the long prompt, passages by id and title, and cites the sources of entities after those of
        chunks. ``compress`` has long passages shortened first.
        """
        began = time.perf_counter()
        k = self.config.final_k if top_k is None else top_k
        entities, chunks = self.retrieve(questions, k)
        chunks = cut(chunks)
        told = chunks
        if compress:
            asked = questions.select(F.col("query_id").cast("bigint").alias("query_id"), "question")
            told = answer.compress(chunks.join(asked, "query_id"), "chunk_text", "question", self.completer).drop("question")
        known = entities.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("entity_text").alias("text"), F.col("entity_type").alias("type"), F.col("entity_description").alias("description"), "similarity"))).alias("entities"))
        passage = F.struct("rank", "chunk_id", F.col("source_doc_id").alias("doc_id"), "title", F.col("chunk_text").alias("text"), "similarity")
        passages = told.groupBy("query_id").agg(F.array_sort(F.collect_list(passage)).alias("all_chunks"))
        texts = chunks.select("query_id", "chunk_id", "chunk_text").distinct()
        if raw:
            cited = answer.citations_with_entities(chunks, entities).join(texts, ["query_id", "chunk_id"], "left")
        else:
            cited = answer.citations(chunks)
        source = F.struct("rank", F.col("source_doc_id").alias("doc_id"), "chunk_id", T.preview(F.col("chunk_text")).alias("text_preview"))
        cited = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
        rows = questions.select(F.col("query_id").cast("bigint").alias("query_id"), "question").join(known, "query_id", "left").join(passages, "query_id", "left").join(cited, "query_id", "left")
        shown = F.slice(F.coalesce("all_chunks", F.array().cast(_CHUNK)), F.lit(1), T.chunk_budget(F.lit(k)))
        ordered = answer.by_similarity(F.coalesce("entities", F.array().cast(_ENTITY)))
        rows = rows.withColumn("prompt", (answer.raw_prompt if raw else answer.prompt)(F.col("question"), ordered, shown))
        out = cut(answer.answer(rows, self.completer).select("query_id", "question", "answer", "sources", T.token_estimate(F.col("prompt")).alias("prompt_tokens"), T.token_estimate(F.col("response")).alias("answer_tokens"), T.token_estimate(F.col("question")).alias("asked")))
        used = out.agg(F.count(F.lit(1)), F.coalesce(F.sum("prompt_tokens"), F.lit(0)), F.coalesce(F.sum("answer_tokens"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
        for name, value in zip(("questions", "prompt_tokens", "answer_tokens", "embedding_tokens"), used, strict=True):
            self.usage[name] += value
        self.usage["query_seconds"] += time.perf_counter() - began
        self.usage["query_calls"] += 1
        return out.select("query_id", "question", "answer", "sources")

    def evaluate(self, points: DataFrame, top_ks: list[int]) -> DataFrame:
        """Predictions of data points (id, question, ground_truth_answer, ground_truth_aliases) for each top-k.

        The processing time of a question is the time of its top-k divided by the number of questions, as all are
        answered together.
        """
        keyed = points.withColumn("query_id", F.xxhash64("id"))
        asked = cut(keyed.select("query_id", "question").distinct())
        parts = []
        for k in top_ks:
            before = self.usage["questions"], self.usage["query_seconds"]
            part = self.query(asked, k)
            seconds = (self.usage["query_seconds"] - before[1]) / max(1, self.usage["questions"] - before[0])
            parts.append(part.withColumn("top_k", F.lit(k)).withColumn("processing_time", F.lit(seconds)))
        told = parts[0]
        for part in parts[1:]:
            told = told.unionByName(part)
        rows = keyed.join(told.drop("question"), "query_id")
        return rows.select(F.xxhash64("id", "top_k").alias("prediction_id"), "id", "top_k", "question", F.col("answer").alias("predicted_answer"), "ground_truth_answer", "ground_truth_aliases", "processing_time", "sources")

    def run_evaluation(self, points: DataFrame, top_ks: list[int], path: str, calculators: dict[str, evaluate.Metric] | None = None) -> DataFrame:
        """Predictions, the sweep over top-k, the report and the usage, written below ``path``; returns the sweep."""
        told = cut(self.evaluate(points, top_ks))
        write_results(told, f"{path}/predictions")
        metrics = calculators or {**evaluate.METRICS, **evaluate.rouge_metrics()}
        rows = cut(evaluate.scored(told, metrics))
        swept = evaluate.sweep(rows, list(metrics))
        for name, table in (("summary", swept), ("analysis", evaluate.report(rows)), ("usage", self.usage_rows())):
            table.write.mode("overwrite").json(f"{path}/{name}")
        return swept


class BaselineEngine(Engine):
    """Plain retrieval: the chunks nearest to a question, in the order of their distance, and no entities.

    Its workspace holds chunks by the recursive splitter; a document is skipped if its id is known, whatever its text.
    """

    def _index(self, docs: DataFrame, force: bool, key: str, text: str, batch: str | None) -> tuple[int, int]:
        return self.workspace.index_chunks(docs, self.config, force, key, text, self.embedder, batch)

    def retrieve(self, questions: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        k = self.config.final_k if top_k is None else top_k
        queries = self._asked(questions).select("query_id", "query_vector")
        passages = self.workspace.vectors("chunk_vectors", self.embedder.dimension)
        listed = nearest(queries, passages, k).join(passages.select("vec_id", F.col("id").alias("chunk_id")), "vec_id").drop("vec_id", "distance")
        none = self.spark.createDataFrame([], "query_id bigint, rank int, entity_text string, entity_type string, entity_description string, similarity double, chunk_id string, source_doc_id string")
        return none, self._passages(listed, self.workspace.table("chunks"), passages, queries)


def write_results(predictions: DataFrame, path: str) -> None:
    """Predictions as JSON, one folder per top-k."""
    predictions.write.mode("overwrite").partitionBy("top_k").json(path)


def read_results(spark: SparkSession, path: str, schema: str = schemas.PREDICTION) -> DataFrame:
    """Predictions as written; none where nothing was."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def results_table(swept: DataFrame) -> DataFrame:
    """A sweep with its figures as text of four decimals, for printing; metrics without any value are left out."""
    held = swept.agg(*[F.count(c).alias(c) for c in swept.columns]).first()
    shown = [(c, t) for c, t in swept.dtypes if held[c] or t != "double"]
    return swept.select(*[F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in shown])


def token_table(usage: DataFrame) -> DataFrame:
    """The token figures of ``usage_rows`` as text, for printing."""
    return usage.where(F.col("part").isin("token_usage", "per_question")).select("part", "name", F.format_string("%.2f", "value").alias("value"))
