"""Vector expressions and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in the query set that is broadcast. Larger sets are dealt into blocks of as many that never pass the driver.
BLOCK_NUMBERS = 4_000_000
#: Distances that a task holds at once.
CELLS = 4_000_000
#: Decimals of distances; ties beyond them are broken by id.
DECIMALS = 9


def squared_l2(a: Column, b: Column) -> Column:
    """The squared Euclidean distance of two vectors, computed in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def centroid(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(key, centroid): the weighted mean of the vectors of each key. Weights default to 1; sums are combined map-side."""
    weight = F.lit(1.0) if weight is None else weight
    parts = rows.select(key, weight.alias("w"), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("centroid"))


class _Best:
    """The k nearest rows per query that a task has seen so far."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.norms = (queries**2).sum(axis=1)
        self.distance = np.full((len(queries), 0), np.inf)
        self.ids = np.empty((len(queries), 0), dtype=np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.queries)))
        for i in range(0, len(ids), step):
            self._add(ids[i : i + step], vectors[i : i + step])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        near = self.norms[:, None] + (vectors**2).sum(axis=1)[None] - 2 * self.queries @ vectors.T
        # Distances of the product lose digits; rows within reach of the k-th are computed anew.
        reach = np.partition(near, min(self.k, near.shape[1]) - 1, axis=1)[:, min(self.k, near.shape[1]) - 1] + 1e-7
        width = int((near <= reach[:, None]).sum(axis=1).max())
        at = np.argpartition(near, width - 1, axis=1)[:, :width] if width < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
        exact = np.stack([((vectors[a] - q) ** 2).sum(axis=1) for a, q in zip(at, self.queries, strict=True)]) if len(self.queries) else near
        distance = np.concatenate([self.distance, np.round(exact, DECIMALS)], axis=1)
        held = np.concatenate([self.ids, ids[at]], axis=1)
        order = np.lexsort((held, distance), axis=1)[:, : self.k]
        self.distance, self.ids = np.take_along_axis(distance, order, 1), np.take_along_axis(held, order, 1)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _found(names: np.ndarray, best: _Best) -> list[pa.Array]:
    n = best.ids.shape[1]
    return [pa.array(np.repeat(names, n)), pa.array(best.ids.ravel()), pa.array(best.distance.ravel())]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, row_id, distance): the k rows of the corpus of least squared distance to each query.

    Every task keeps the k best per query over all its rows, and only those are shuffled. A query set of at most
    ``BLOCK_NUMBERS`` numbers is broadcast; of a larger one each block meets each block of the corpus in a task. Rows or
    queries without vector or id are left out; equal distances go by id; an empty corpus gives no rows. Ids are whole
    numbers, and all vectors have one length.
    """
    spark = corpus.sparkSession
    asked = queries.where(F.col(query_id).isNotNull() & F.col(query_vector).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), F.col(query_vector).alias("v"))
    held = corpus.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("i"), F.col(vector).alias("v"))
    schema = f"`{query_id}` bigint, `{row_id}` bigint, distance double"
    # Numbers beyond the bound decide for blocks; no more than the bound are fetched.
    first = asked.limit(1).collect()
    most = max(1, BLOCK_NUMBERS // max(1, len(first[0]["v"]))) if first else 1
    block = asked.limit(most + 1).toArrow() if first else None
    if block is None or block.num_rows <= most:
        names = block["q"].to_numpy() if block is not None else np.empty(0, dtype=np.int64)
        shared = spark.sparkContext.broadcast((names, _matrix(block["v"], len(names)) if len(names) else np.empty((0, 0))))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            best = _Best(vectors, k)
            for batch in batches:
                if batch.num_rows and len(names):
                    best.add(batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows))
            yield pa.RecordBatch.from_arrays(_found(names, best), [query_id, row_id, "distance"])

        found = held.mapInArrow(search, schema)
    else:
        width = len(first[0]["v"])
        query_blocks, row_blocks = (max(1, -(-df.count() * width // BLOCK_NUMBERS)) for df in (asked, held))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            names = left["q"].to_numpy()
            best = _Best(_matrix(left["v"], len(names)) if len(names) else np.empty((0, 0)), k)
            if len(names) and right.num_rows:
                best.add(right["i"].to_numpy(), _matrix(right["v"], right.num_rows))
            return pa.table(_found(names, best), [query_id, row_id, "distance"])

        def dealt(df: DataFrame, key: str, own: int, other: int, names: tuple[str, str]) -> DataFrame:
            return df.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(own))).withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other - 1).cast("bigint"))))

        left = dealt(asked, "q", query_blocks, row_blocks, ("a", "b")).groupBy("a", "b")
        right = dealt(held, "i", row_blocks, query_blocks, ("b", "a")).groupBy("a", "b")
        found = left.cogroup(right).applyInArrow(meet, schema)
    order = Window.partitionBy(query_id).orderBy("distance", row_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", row_id, "distance")
