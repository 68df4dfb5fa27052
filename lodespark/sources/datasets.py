"""QA sets: raw readers, normalisers to one sample type, and views of normalised samples."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark import schemas
from lodespark.functions import text as T
from lodespark.functions.text import blank


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A raw set of ``[title, [sentence, ...]]`` contexts: one JSON array per file."""
    return spark.read.schema(schemas.RAW_PAIRS).option("multiLine", True).json(path)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """A raw set of paragraph objects: one JSON object per line."""
    return spark.read.schema(schemas.RAW_PARAGRAPHS).json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Normalised samples, one JSON object per line."""
    return spark.read.schema(schemas.SAMPLE).json(path)


def write_samples(samples: DataFrame, path: str, limit: int | None = None) -> None:
    """Samples with an id, one JSON object per line; ``limit`` counts the samples written, in the order of their ids."""
    whole = samples.where(F.col("id").isNotNull())
    (whole if limit is None else first_samples(whole, limit)).write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str = schemas.SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected lines) of a file of JSON lines: lines that cannot be read are kept apart as they are."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad"), rows.where(F.col("_bad").isNotNull()).select(F.col("_bad").alias("line"))


class Loader(Protocol):
    """What an evaluation needs of a set of questions."""

    def load_data(self, limit: int | None = None) -> DataFrame:
        """(id, question, contexts, ground_truth_answer, ground_truth_aliases)"""
        ...

    def documents(self) -> DataFrame:
        """(id, title, text) to be indexed."""
        ...


class SampleLoader:
    """A loader of normalised samples of one set."""

    def __init__(self, spark: SparkSession, dataset: str, path: str) -> None:
        self.spark, self.dataset, self.path = spark, dataset, path

    def load_data(self, limit: int | None = None) -> DataFrame:
        samples = read_samples(self.spark, self.path)
        return data_points(samples if limit is None else first_samples(samples, limit), self.dataset)

    def documents(self) -> DataFrame:
        return documents_for_indexing(self.load_data())


#: Where the normalised samples of a set lie below the data folder.
PATHS = {"hotpotqa": "hotpotqa/processed.jsonl", "2wiki": "2wiki/processed.jsonl", "musique": "musique/processed.jsonl"}


def loader(spark: SparkSession, dataset: str, folder: str) -> SampleLoader:
    """The loader of a known set below a data folder; an error if the set is unknown or its samples are not there."""
    if dataset not in PATHS:
        raise ValueError(f"unknown set {dataset!r}, not one of {sorted(PATHS)}")
    path = f"{folder.rstrip('/')}/{PATHS[dataset]}"
    # The path is resolved here, so that a missing one shows at once.
    read_samples(spark, path)
    return SampleLoader(spark, dataset, path)


def hop(identifier: Column) -> Column:
    return T.hop(identifier)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _struct(identifier: Column, title: Column, chunk: Column) -> Column:
    return F.struct(identifier.alias("id"), title.alias("title"), chunk.alias("chunk"))


def _cited(chunks: Column, facts: Column) -> Column:
    """The chunks that facts name by title, once each in the order of first mention; of equal titles the last chunk."""
    found = F.transform(F.coalesce(facts, _empty("array<array<string>>")), lambda f: F.try_element_at(F.filter(chunks, lambda c: c["title"] == F.get(f, 0)), F.lit(-1)))
    return F.filter(F.array_distinct(found), lambda c: c.isNotNull())


def normalize_pairs(raw: DataFrame, with_evidences: bool = False) -> DataFrame:
    """Samples of a pair set: chunk text is title, colon and sentences. Evidences of fewer than three parts are dropped."""
    context = F.coalesce("context", _empty("array<array<string>>"))

    def chunk(c: Column, i: Column) -> Column:
        title = F.get(c, 0)
        sentences = F.coalesce(F.from_json(F.get(c, 1), "array<string>"), _empty("array<string>"))
        return _struct(F.concat(F.col("_id"), F.lit("_ctxchunk_"), i.cast("string")), title, F.concat(title, F.lit(": "), F.array_join(sentences, " ")))

    triples = F.transform(F.filter(F.coalesce("evidences", _empty("array<array<string>>")), lambda e: F.size(e) >= 3), lambda e: F.struct(F.get(e, 0).alias("subject"), F.get(e, 1).alias("relation"), F.get(e, 2).alias("object")))
    rows = raw.withColumn("chunks", F.transform(context, chunk))
    evidences = triples if with_evidences else _empty("array<struct<subject:string,relation:string,object:string>>")
    return rows.select(F.col("_id").alias("id"), F.lit(2).alias("hop"), "type", "question", "answer", _empty("array<string>").alias("answer_aliases"), "chunks", _cited(F.col("chunks"), F.col("supporting_facts")).alias("supporting_facts"), _empty("array<struct<id:string,question:string,answer:string>>").alias("decomposition"), evidences.alias("evidences"))


def normalize_paragraphs(raw: DataFrame) -> DataFrame:
    """Samples of a paragraph set; unanswerable ones are dropped. Supporting facts have ids of a form of their own."""
    rows = raw.where(F.coalesce("answerable", F.lit(True)))
    kind = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    indexed = F.transform(F.coalesce("paragraphs", _empty(kind)), lambda p, i: F.struct(F.coalesce(p["idx"], i).alias("n"), p["title"].alias("title"), p["paragraph_text"].alias("chunk"), F.coalesce(p["is_supporting"], F.lit(False)).alias("s")))

    def as_chunks(prefix: str, rows: Column) -> Column:
        return F.transform(rows, lambda p: _struct(F.concat(F.col("id"), F.lit(prefix), p["n"].cast("string")), p["title"], p["chunk"]))

    return rows.withColumn("__p", indexed).select("id", hop(F.col("id")).alias("hop"), F.lit(None).cast("string").alias("type"), "question", "answer", F.coalesce("answer_aliases", _empty("array<string>")).alias("answer_aliases"), as_chunks("_chunk_", F.col("__p")).alias("chunks"), as_chunks("_sf_chunk_", F.filter("__p", lambda p: p["s"])).alias("supporting_facts"), F.coalesce("question_decomposition", _empty("array<struct<id:string,question:string,answer:string>>")).alias("decomposition"), _empty("array<struct<subject:string,relation:string,object:string>>").alias("evidences"))


def first_samples(samples: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` samples in a given order: a test subset."""
    return samples.orderBy(order).limit(n)


def data_points(samples: DataFrame, dataset: str) -> DataFrame:
    """(id, question, contexts, ground_truth_answer, ground_truth_aliases) of one set, by its own rule of contexts."""
    empty = _empty(schemas.PARAGRAPHS)
    chunks, facts = F.coalesce("chunks", empty), F.coalesce("supporting_facts", empty)
    aliases = F.coalesce("answer_aliases", _empty("array<string>"))
    if dataset == "hotpotqa":
        contexts = facts
    elif dataset == "2wiki":
        contexts, aliases = F.filter(chunks, lambda c: ~blank(c["id"]) & ~blank(c["chunk"])), _empty("array<string>")
    else:
        contexts = chunks
    return samples.select("id", "question", contexts.alias("contexts"), F.col("answer").alias("ground_truth_answer"), aliases.alias("ground_truth_aliases"))


def documents_for_indexing(points: DataFrame) -> DataFrame:
    """(id, title, text): every context as a document; repeated ones stay."""
    return points.select(F.explode("contexts").alias("c")).select("c.id", "c.title", F.col("c.chunk").alias("text"))


def question_documents(points: DataFrame) -> DataFrame:
    """(id, doc_ids): the contexts' ids of each question."""
    return points.select("id", F.transform("contexts", lambda c: c["id"]).alias("doc_ids"))
