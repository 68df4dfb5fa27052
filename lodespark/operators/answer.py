"""Contexts, prompts, answers and citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions import models
from lodespark.functions import text as T

NO_CONTEXT = "Answer the question. Reply with one line that begins with FINAL_ANSWER_TEXT:\nQuestion: "
WITH_CONTEXT = "Use what is given below to answer the question. Reply with one line that begins with FINAL_ANSWER_TEXT:\n"

RAW_HEAD = "You are given entities and passages. Rest the answer on them alone, say which passages it rests on, and be brief.\n\n"
RAW_FOOT = "\nReply with one line that begins with FINAL_ANSWER_TEXT:"
COMPRESS = "Keep of the passage only what helps to answer the question.\nQuestion: {question}\nPassage: {text}"


def entity_lines(entities: Column) -> Column:
    """Numbered lines of an array of (text, type, description), in its order."""

    def line(e: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(". "), e["text"], F.lit(" (Type: "), e["type"], F.lit(")"), F.when(e["description"] != "", F.concat(F.lit(": "), e["description"])).otherwise(F.lit("")))

    return F.array_join(F.transform(entities, line), "\n")


def passage_blocks(chunks: Column, raw: bool = False) -> Column:
    """Numbered passages of an array of (chunk_id, doc_id, title, text, similarity)."""

    def block(c: Column, i: Column) -> Column:
        number = F.concat(F.lit("Passage "), (i + 1).cast("string"))
        if raw:
            head = F.concat(number, F.lit(" (ID: "), c["chunk_id"], F.lit(", From Document: "), F.coalesce(c["doc_id"], F.lit("unknown")), F.lit(", Title: "), F.coalesce(c["title"], F.lit("none")), F.lit(")"))
        else:
            head = F.concat(number, F.lit(" (Relevance: "), F.format_string("%.2f", F.coalesce(c["similarity"], F.lit(0.0))), F.lit(")"))
        return F.concat(head, F.lit(":\n"), F.coalesce(c["text"], F.lit("")))

    return F.array_join(F.transform(chunks, block), "\n\n")


def prompt(question: Column, entities: Column, chunks: Column) -> Column:
    """The prompt of a question: with entities, chunks or both, or without context."""
    known = F.when(F.size(entities) > 0, F.concat(F.lit("Entities:\n"), entity_lines(entities), F.lit("\n"))).otherwise(F.lit(""))
    passages = F.when(F.size(chunks) > 0, F.concat(F.lit("Passages:\n"), passage_blocks(chunks), F.lit("\n"))).otherwise(F.lit(""))
    nothing = (F.size(entities) <= 0) & (F.size(chunks) <= 0)
    return F.when(nothing, F.concat(F.lit(NO_CONTEXT), question)).otherwise(F.concat(F.lit(WITH_CONTEXT), known, passages, F.lit("Question: "), question))


def raw_prompt(question: Column, entities: Column, chunks: Column) -> Column:
    """The long prompt, one template whatever is known: entities, then passages with their ids and titles."""
    known = F.when(F.size(entities) > 0, entity_lines(entities)).otherwise(F.lit("none"))
    passages = F.when(F.size(chunks) > 0, passage_blocks(chunks, raw=True)).otherwise(F.lit("none"))
    return F.concat(F.lit(RAW_HEAD), F.lit("Entities:\n"), known, F.lit("\n\nPassages:\n"), passages, F.lit("\n\nQuestion: "), question, F.lit(RAW_FOOT))


def by_similarity(entities: Column) -> Column:
    """An array of entities with a similarity, the most similar first, equals in their order."""
    placed = F.transform(entities, lambda e, i: F.struct((-e["similarity"]).alias("s"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda p: p["e"])


def citations_with_entities(chunks: DataFrame, entities: DataFrame, query: str = "query_id", doc: str = "source_doc_id", rank: str = "rank") -> DataFrame:
    """The first source of each document of a query: chunks first, then the sources of entities.

    Both have the columns query, doc, rank and chunk_id; rows without a document are left out.
    """
    columns = [query, doc, rank, "chunk_id"]
    both = chunks.select(*columns, F.lit(0).alias("__s")).unionByName(entities.select(*columns, F.lit(1).alias("__s"))).where(F.col(doc).isNotNull())
    first = F.row_number().over(Window.partitionBy(query, doc).orderBy("__s", rank, "chunk_id"))
    placed = both.withColumn("__n", first).where(F.col("__n") == 1)
    return placed.select(query, doc, "chunk_id", F.row_number().over(Window.partitionBy(query).orderBy("__s", rank, "chunk_id")).alias(rank))


def compress(rows: DataFrame, text: str, question: str, completer: models.Completer, words: int = 300) -> DataFrame:
    """``rows`` with long passages replaced by what a completer keeps of them for the question; as they are if it fails."""

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, questions: pd.Series) -> pd.Series:
        asked = (COMPRESS.format(question=q or "", text=t or "") for t, q in zip(texts, questions, strict=True))
        return pd.Series([models.with_retries(lambda p=p: completer.complete(p), attempts=2, default="", wanted=bool) for p in asked], dtype="object")

    long = rows.where(too_long(F.col(text), words)).withColumn("__short", shorten(text, question))
    put = F.when(T.blank(F.col("__short")), F.col(text)).otherwise(F.col("__short"))
    return rows.where(~too_long(F.col(text), words)).unionByName(long.withColumn(text, put).drop("__short"))


def citations(chunks: DataFrame, query: str = "query_id", doc: str = "source_doc_id", rank: str = "rank") -> DataFrame:
    """The first chunk of each document of a query, in the order of the chunks."""
    first = F.row_number().over(Window.partitionBy(query, doc).orderBy(rank, "chunk_id"))
    return chunks.withColumn("__n", first).where(F.col("__n") == 1).drop("__n")


def answer(rows: DataFrame, completer: models.Completer | None = None) -> DataFrame:
    """``rows`` with a ``prompt`` column and the ``answer`` parsed from its completion."""
    return models.complete_prompts(rows, "prompt", completer or models.EchoCompleter()).withColumn("answer", T.parse_answer(F.col("response")))


def too_long(text: Column, words: int = 300) -> Column:
    """Whether a passage is long enough to be compressed before it goes into a context."""
    return T.word_count(text) > words
