"""Pluggable models and their deterministic stand-ins.

The engine calls an embedder, an extractor and a completer through these protocols. The stand-ins need no network and
give the same result on every run, so that every query can be reproduced; real clients implement the same methods and
run inside the Arrow UDFs.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import text as T
from lodespark.session import cut

#: What one call of a model sees: characters of embedding and of extraction input. Longer texts are embedded in pieces.
EMBED_CHARS = 2048
EXTRACT_CHARS = 4000
#: Pieces embedded in one call.
EMBED_ROWS = 10_000
#: A text that one in this many rows has is joined by broadcast.
HOT = 100


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class Extractor(Protocol):
    """Answers with the entities of a text of at most ``EXTRACT_CHARS`` characters, as a JSON array somewhere in its response."""

    def respond(self, text: str) -> str: ...


class PromptedExtractor:
    """An extractor that asks a completer."""

    PROMPT = "List the entities of the text as a JSON array of objects with text, type, description and importance_score (1 to 5). Types: {types}.\nText: {text}"

    def __init__(self, completer: Completer) -> None:
        self.completer = completer

    def respond(self, text: str) -> str:
        from lodespark.functions.text import TYPES

        return with_retries(lambda: self.completer.complete(self.PROMPT.format(types=", ".join(TYPES), text=text)), attempts=2, default="", wanted=bool)


class CachedEmbedder:
    """An embedder that keeps the vectors of the last ``capacity`` different texts, first in first out, per process."""

    def __init__(self, embedder: Embedder, capacity: int = 10_000) -> None:
        self.embedder, self.capacity, self.dimension = embedder, capacity, embedder.dimension
        self.held: dict[str, list[float]] = {}
        self.hits = self.misses = 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        new = [t for t in dict.fromkeys(texts) if t not in self.held]
        fresh = dict(zip(new, self.embedder.embed(new), strict=True)) if new else {}
        out = [fresh[t] if t in fresh else self.held[t] for t in texts]
        self.misses += len(new)
        self.hits += len(texts) - len(new)
        for text, vector in fresh.items():
            if len(self.held) >= self.capacity:
                del self.held[next(iter(self.held))]
            self.held[text] = vector
        return out

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.held), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


class HashEmbedder:
    """Words counted in hashed buckets, scaled to length 1; blank texts give the zero vector."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension] += 1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).tolist()


class EchoCompleter:
    """Answers with the first entity of the prompt."""

    def complete(self, prompt: str) -> str:
        first = re.search(r"^1\. (.*?) \(Type: ", prompt, re.MULTILINE)
        return f"FINAL_ANSWER_TEXT: {first.group(1)}" if first else "FINAL_ANSWER_TEXT: NOT FOUND"


def with_retries(call: Callable[[], object], attempts: int = 3, delay: float = 1.0, default: object = None, wanted: Callable[[object], bool] = lambda _: True) -> object:
    """The result of ``call``; ``default`` if every attempt fails. A call that raises is tried again after a pause, one whose result is not ``wanted`` at once."""
    for attempt in range(attempts):
        try:
            if wanted(result := call()):
                return result
        except Exception:
            if attempt + 1 < attempts:
                time.sleep(delay)
    return default


def embed_pieces(text: str, size: int = EMBED_CHARS) -> list[str]:
    """``text`` in pieces of at most ``size`` characters, cut before white space where there is any."""
    out, start = [], 0
    while len(text) - start > size:
        at = max(text.rfind(c, start + 1, start + size + 1) for c in " \t\r\n")
        stop = at if at > start else start + size
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]]


def embed_texts(texts: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """``texts`` with a vector per row. Each distinct text is embedded once; blank or failed texts get the zero vector.

    A text longer than a model's input is embedded in pieces; its vector is the mean of theirs, weighted by their
    lengths and scaled to length 1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = [0.0] * embedder.dimension
        for batch in batches:
            pieces = [embed_pieces(t) for t in batch["__text"]]
            flat = [p for parts in pieces for p in parts]
            vectors = []
            for at in range(0, len(flat), EMBED_ROWS):
                vectors += with_retries(lambda given=flat[at : at + EMBED_ROWS]: embedder.embed(given), default=[[]] * len(flat[at : at + EMBED_ROWS]))
            united, at = [], 0
            for parts in pieces:
                own = vectors[at : at + len(parts)]
                at += len(parts)
                if any(len(v) != embedder.dimension for v in own):
                    united.append(zero)
                elif len(own) == 1:
                    united.append(own[0])
                else:
                    mean = np.average(np.array(own), axis=0, weights=[len(p) for p in parts])
                    length = np.linalg.norm(mean)
                    united.append((mean / length if length > 0 else mean).tolist())
            yield pd.DataFrame({"__text": batch["__text"], out: united})

    counted = texts.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    # Embedded once, whatever the joins below read.
    vectors = cut(counted.select("__text", "__n").join(counted.select("__text").mapInPandas(run, f"__text string, `{out}` array<float>"), "__text"))
    total = vectors.agg(F.sum("__n").alias("__all"))
    # Texts that at least one in HOT rows has: at most HOT of them. The others are joined by hash.
    held = vectors.join(F.broadcast(total), F.lit(True), "inner").withColumn("__hot", F.col("__n") * HOT >= F.col("__all"))
    hot = F.broadcast(held.where("__hot").select(F.col("__text").alias("__h"), F.col(out).alias("__hv")))
    cold = held.where(~F.col("__hot")).select("__text", F.col(out).alias("__cv"))
    joined = texts.join(hot, F.col(text) == F.col("__h"), "left")
    # Hot texts look for nothing in the second join.
    key = F.when(F.col("__h").isNull(), F.col(text)).otherwise(F.concat(F.lit("#"), F.floor(F.rand(7) * 1024).cast("string"), F.lit("#")))
    joined = joined.withColumn("__k", key).join(cold, (F.col("__k") == F.col("__text")) & F.col("__h").isNull(), "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), embedder.dimension)
    return joined.withColumn(out, F.coalesce("__hv", "__cv", zero)).select(*texts.columns, out)


def complete_prompts(rows: DataFrame, prompt: str, completer: Completer, out: str = "response") -> DataFrame:
    """``rows`` with a completion per prompt; an empty one where the completer fails or says nothing twice."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: with_retries(lambda: completer.complete(p or ""), attempts=2, default="", wanted=bool))

    return rows.withColumn(out, run(F.col(prompt)))


def extract_entities(text: Column) -> Column:
    """Stand-in extractor: runs of capitalised ASCII words, with a type and an importance that depend on the text alone.

    It calls no model and so reads the whole text, as calls over pieces within ``EXTRACT_CHARS`` would together, but
    without a piece's end inside a run.
    """
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))

    def entity(e: Column) -> Column:
        kind = F.when(F.contains(e, F.lit(" ")), F.lit("PERSON")).otherwise(F.lit("MISC"))
        return F.struct(e.alias("text"), kind.alias("type"), F.lit("").alias("description"), F.least(F.greatest(F.floor(F.length(e) / 4).cast("int"), F.lit(1)), F.lit(5)).cast("double").alias("importance_score"))

    return F.transform(found, entity)


def extract(rows: DataFrame, text: str, extractor: Extractor | None = None, out: str = "entities") -> DataFrame:
    """``rows`` with an array of entities (text, type, description, importance_score) of a text column.

    Without an extractor the stand-in is used. An extractor is asked for pieces of at most ``EXTRACT_CHARS`` characters,
    and what it finds in any piece counts once; responses are salvaged and their types brought to the known ones.
    """
    if extractor is None:
        return rows.withColumn(out, extract_entities(F.col(text)))

    @F.pandas_udf("array<string>")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [with_retries(lambda p=p: extractor.respond(p), attempts=1, default="") for p in embed_pieces(t, EXTRACT_CHARS)] if t else [])

    def known(e: Column) -> Column:
        return F.struct(e["text"].alias("text"), T.canonical_type(e["type"]).alias("type"), e["description"].alias("description"), e["importance_score"].alias("importance_score"))

    return rows.withColumn(out, F.array_distinct(F.flatten(F.transform(ask(F.col(text)), lambda r: F.transform(T.salvage_json(r), known)))))


def query_cues(questions: DataFrame, question: str, extractor: Extractor | None = None, out: str = "cues") -> DataFrame:
    """``questions`` with the texts of the entities that they name, once each."""
    return extract(questions, question, extractor, "__found").withColumn(out, F.array_distinct(F.transform("__found", lambda e: e["text"]))).drop("__found")
