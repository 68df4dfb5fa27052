"""Retrieval over vectors: plain, associative and hybrid, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.config import EngineConfig
from lodespark.functions.vectors import centroid, cosine, nearest
from lodespark.session import cut


def with_status(queries: DataFrame, corpus: DataFrame, k: int, statuses: list[str] | None, overfetch: int | None = 3) -> DataFrame:
    """The k nearest rows of an allowed status among the ``overfetch * k`` nearest of any; without statuses the k nearest.

    Over-fetching may leave fewer than k rows, as the reference does; ``overfetch=None`` finds the k nearest of an
    allowed status exactly.
    """
    if statuses is None:
        return nearest(queries, corpus, k)
    if overfetch is None:
        return nearest(queries, corpus.where(F.col("status").isin(statuses)), k)
    near = nearest(queries, corpus, overfetch * k).join(corpus.select("vec_id", "status"), "vec_id").where(F.col("status").isin(statuses))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def first_per(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", place).where(F.col("__n") == 1).drop("__n")


def chunk_list(found: DataFrame, direct: DataFrame, chunk_of: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, chunk_id): chunks of the entities found, then chunks found directly, first come, once each.

    ``chunk_of`` maps vec_id to chunk_id; rows without a chunk are dropped.
    """
    associated = found.join(chunk_of, "vec_id").select("query_id", F.lit(0).alias("source"), "rank", "chunk_id")
    both = associated.unionByName(direct.select("query_id", F.lit(1).alias("source"), "rank", "chunk_id"))
    once = first_per(both, ["query_id", "chunk_id"], "source", "rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("source", "rank", "chunk_id"))
    return once.withColumn("place", place).where(F.col("place") <= limit).select("query_id", F.col("place").alias("rank"), "chunk_id")


def associative(queries: DataFrame, corpus: DataFrame, config: EngineConfig) -> DataFrame:
    """(query_id, discovery, vec_id, distance): the nearest rows, then those near the centroid of the first seeds.

    Each round takes the first ``seed_limit`` rows discovered, searches around their mean and adds what is new. Weights
    are uniform or, by ``weighting='similarity'``, the cosine to the query.
    """
    return associative_hits(queries, corpus, config)[0]


def associative_hits(queries: DataFrame, corpus: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """What ``associative`` finds, and every hit of its searches (query_id, vec_id), rows that were known already too.

    What a round found is cut, as the next one and the result both read it.
    """
    found = cut(nearest(queries, corpus, config.initial_k).select("query_id", F.col("rank").alias("discovery"), "vec_id", "distance"))
    hits = found.select("query_id", "vec_id")
    for _ in range(config.depth):
        seeds = found.where(F.col("discovery") <= config.seed_limit).join(corpus.select("vec_id", "embedding"), "vec_id")
        weight = None
        if config.weighting == "similarity":
            seeds = seeds.join(queries, "query_id").withColumn("w", cosine(F.col("embedding"), F.col("query_vector")))
            weight = F.col("w")
        means = centroid(seeds, "query_id", "embedding", weight).withColumnRenamed("centroid", "query_vector")
        near = cut(nearest(means, corpus, config.secondary_factor * config.initial_k))
        hits = hits.unionByName(near.select("query_id", "vec_id"))
        fresh = near.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
        last = found.groupBy("query_id").agg(F.max("discovery").alias("last"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        fresh = fresh.withColumn("place", place).join(last, "query_id").select("query_id", (F.col("last") + F.col("place")).alias("discovery"), "vec_id", "distance")
        found = found.unionByName(fresh)
    return found, hits


def rerank(found: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, similarity): rows found, by cosine to the query; equals in order of discovery."""
    scored = found.join(corpus.select("vec_id", "embedding"), "vec_id").join(queries, "query_id")
    scored = scored.select("query_id", "discovery", "vec_id", F.round(cosine(F.col("embedding"), F.col("query_vector")), 9).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "discovery"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def hybrid(queries: DataFrame, corpus: DataFrame, chunk_vectors: DataFrame, chunk_of: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id): chunks of the k nearest entities and the k nearest chunks, once each."""
    entities = nearest(queries, corpus, k).join(chunk_of, "vec_id").select("query_id", "chunk_id")
    direct = nearest(queries, chunk_vectors, k).join(chunk_of, "vec_id").select("query_id", "chunk_id")
    return entities.unionByName(direct).distinct()


def access_log(*results: DataFrame) -> DataFrame:
    """(vec_id, accesses): how often rows were returned by searches."""
    log = results[0].select("vec_id")
    for r in results[1:]:
        log = log.unionByName(r.select("vec_id"))
    return log.groupBy("vec_id").agg(F.count(F.lit(1)).alias("accesses"))


def short_term_memory(events: DataFrame, session: str, item: str, order: str, capacity: int) -> DataFrame:
    """(session, item, seq): the last ``capacity`` different items of a session by their first insertion."""
    first = events.where(F.col(item).isNotNull()).groupBy(session, item).agg(F.min(order).alias("seq"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("seq"), item))
    return first.withColumn("n", place).where(F.col("n") <= capacity).select(session, item, "seq")


def statuses(activations: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces (vec_id) with their status: active once any search has newly associated them, else dormant."""
    return traces.join(activations.select("vec_id").distinct().withColumn("a", F.lit(True)), "vec_id", "left").select("vec_id", F.when(F.col("a"), F.lit("active_in_stm")).otherwise(F.lit("dormant")).alias("status"))
