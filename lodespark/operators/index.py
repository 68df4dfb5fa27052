"""Indexing: new documents to chunks, entity traces, a graph and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.config import EngineConfig
from lodespark.functions import models
from lodespark.functions import text as T
from lodespark.operators import chunking


def valid_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with an id and a text that is not blank."""
    return docs.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & ~T.blank(F.col(text)))


def manifest_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content_md5) of documents."""
    return docs.select(F.col(key).cast("string").alias("doc_id"), T.md5_hex(F.col(text)).alias("content_md5"))


def new_documents(docs: DataFrame, manifest: DataFrame, by_content: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that the manifest does not hold: with this content or, by id alone, at all."""
    named = docs.withColumn("__id", F.col(key).cast("string")).withColumn("__md5", T.md5_hex(F.col(text)))
    same = named["__id"] == manifest["doc_id"]
    if by_content:
        same = same & (named["__md5"] == manifest["content_md5"])
    return named.join(manifest, same, "left_anti").drop("__id", "__md5")


def traces_of(chunks: DataFrame, extractor: models.Extractor | None = None) -> DataFrame:
    """One trace per entity mention of a chunk, with a key made of chunk, place and text, and the documented defaults."""
    found = models.extract(chunks.select("chunk_id", "source_doc_id", "chunk_text"), "chunk_text", extractor, "entities")
    found = found.select("chunk_id", "source_doc_id", F.posexplode("entities").alias("pos", "e"))
    return found.select(
        F.md5(F.concat_ws("|", "chunk_id", "pos", "e.text")).alias("id"), F.col("e.text").alias("entity_text"), F.col("e.type").alias("entity_type"), F.col("e.description").alias("entity_description"),
        F.col("e.importance_score").alias("entity_importance"), F.col("chunk_id").alias("source_chunk_id"), "source_doc_id", F.lit("dormant").alias("status"), F.lit(0).cast("bigint").alias("access_count"),
        F.current_timestamp().alias("created_at"),
    )


def with_defaults(traces: DataFrame) -> DataFrame:
    """Traces with missing fields filled in; traces without entity text are dropped."""
    fill = {"entity_type": F.lit("MISC"), "entity_description": F.lit(""), "entity_importance": F.lit(3.0), "status": F.lit("dormant"), "access_count": F.lit(0).cast("bigint")}
    return traces.where(F.col("entity_text") != "").select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in traces.columns])


def graph_edges(traces: DataFrame) -> DataFrame:
    """(source, target, type): each entity to the chunk it was found in."""
    return traces.where(F.col("id").isNotNull() & F.col("source_chunk_id").isNotNull()).select(F.col("id").alias("source"), F.col("source_chunk_id").alias("target"), F.lit("EXTRACTED_FROM").alias("type"))


def graph_nodes(traces: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, type, text, metadata): entities and chunks, once each; metadata as JSON without type and text."""
    entities = traces.select("id", F.lit("entity").alias("type"), F.col("entity_text").alias("text"), F.to_json(F.struct("entity_type", F.col("entity_description").alias("description"))).alias("metadata"))
    passages = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), F.col("chunk_text").alias("text"), F.to_json(F.struct(F.col("source_doc_id").alias("doc_id"))).alias("metadata"))
    return entities.unionByName(passages).where(F.col("id").isNotNull()).distinct()


def index_documents(docs: DataFrame, manifest: DataFrame | None, config: EngineConfig, key: str = "doc_id", text: str = "text", splitter: str = "sliding", by_content: bool = True, extractor: models.Extractor | None = None) -> dict[str, DataFrame]:
    """Tables to append for the documents that ``manifest`` does not hold yet: chunks, traces, edges and manifest."""
    fresh = valid_documents(docs, key, text)
    if manifest is not None:
        fresh = new_documents(fresh, manifest, by_content, key, text)
    chunks = chunking.chunks(fresh, key, text, config, splitter, "title" if "title" in docs.columns and "title" not in (key, text) else None)
    traces = traces_of(chunks, extractor)
    return {"chunks": chunks, "traces": traces, "edges": graph_edges(traces), "manifest": manifest_of(fresh, key, text)}


def vectors_of(rows: DataFrame, key: str, content: Column, embedder: models.Embedder, first: int = 0) -> DataFrame:
    """(vec_id, id, embedding): a vector per id, numbered on from ``first`` in the order of the ids.

    Every vector must have the embedder's dimension, or the job fails; ids are embedded once each.
    """
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), content.alias("text")).dropDuplicates(["id"])
    embedded = models.embed_texts(named, "text", embedder).select("id", checked(F.col("embedding"), embedder.dimension).alias("embedding"))
    numbered = sequenced(embedded, "id", "vec_id")
    return numbered.select((F.col("vec_id") + first).alias("vec_id"), "id", "embedding")


def checked(vector: Column, dimension: int) -> Column:
    """``vector``, or an error if it has another dimension."""
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.concat(F.lit(f"a vector needs {dimension} numbers, not "), F.size(vector).cast("string"))).cast("array<float>"))


def lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the ids asked for (a column ``id``), once per id and row."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def sequenced(rows: DataFrame, order: str, out: str = "seq") -> DataFrame:
    """``rows`` numbered from 0 in the order of a unique column, without one task seeing all rows.

    Rows are range-partitioned and sorted; each partition numbers its rows from the sum of the sizes before it. The
    driver holds one count per partition.
    """
    from pyspark.sql import Window

    from lodespark.session import cut

    parts = cut(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part], total = total, total + n
    offsets = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.create_map().cast("map<int,int>")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.withColumn(out, (F.try_element_at(offsets, F.col("__part")) + place).cast("bigint")).drop("__part")
