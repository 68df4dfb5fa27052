"""Per-key results over keys of which a handful hold most rows.

Multi-level tree aggregation. The input is read as chunks of a fixed number of rows. Level 0 combines each chunk
locally (Spark's map-side aggregation, one state per key and chunk). Chunks are spread evenly over slots, and every further level merges the states
of ``fan_in`` slots, so that after the logarithm of the number of chunks no key has more than ``fan_in`` states left
and the last merge of even the heaviest key reads only those. No reducer ever receives all partials of a hot key.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates whose states merge with themselves: name -> (combine, merge).
MERGES = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def chunk_number(rows_per_chunk: int) -> Column:
    """The number of the fixed-size input chunk of a row: its partition and its place there."""
    place = F.monotonically_increasing_id()
    within = place.bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftright(place, 33) + F.lit(1 << 20) * F.floor(within / rows_per_chunk)


def levels_for(df: DataFrame, fan_in: int) -> int:
    """Merge rounds above the chunks, from the size that the optimizer expects of ``df``; nothing is run for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return min(6, max(1, math.ceil(math.log(max(2, size / part), fan_in))))


def tree_aggregate(df: DataFrame, keys: list[str], states: dict[str, tuple[str, Column]], rows_per_chunk: int = 1 << 20, fan_in: int = 16, levels: int | None = None) -> DataFrame:
    """``df`` grouped by ``keys`` with one column per state, merged through rounds of ``fan_in``.

    ``states`` maps a column name to an aggregate of ``MERGES`` and its argument. Null keys form a group of their own,
    as in GROUP BY. Every row takes part; an empty input gives an empty result. Columns of ``df`` that are neither key
    nor argument are not read.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    levels = levels_for(df, fan_in) if levels is None else levels
    slots = fan_in**levels
    arguments = [argument.alias(f"__{name}") for name, (_, argument) in states.items()]
    merged = df.select(*keys, *arguments, F.pmod(F.xxhash64(chunk_number(rows_per_chunk)), F.lit(slots)).alias("__slot"))
    first = [(F.count if kind == "count" else MERGES[kind])(F.col(f"__{name}")).alias(f"__{name}") for name, (kind, _) in states.items()]
    again = [MERGES[kind](F.col(f"__{name}")).alias(f"__{name}") for name, (kind, _) in states.items()]
    merged = merged.groupBy(*keys, "__slot").agg(*first)
    for _ in range(levels - 1):
        merged = merged.withColumn("__slot", F.floor(F.col("__slot") / fan_in)).groupBy(*keys, "__slot").agg(*again)
    merged = merged.groupBy(*keys).agg(*again)
    return merged.select(*keys, *[F.col(f"__{name}").alias(name) for name in states])


def tree_distinct(df: DataFrame, keys: list[str], value: str, name: str, **tree: int) -> DataFrame:
    """Distinct non-null values of ``value`` per key.

    Pairs of key and value are made distinct first, which spreads a hot key over its values, and the pairs are then
    counted by tree aggregation. Keys with nulls only have no row.
    """
    pairs = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return tree_aggregate(pairs, keys, {name: ("count", F.col(value))}, **tree)


def field_rows(df: DataFrame, fields: list[str], *carry: str) -> DataFrame:
    """(field, key_value, carried columns): one row per non-null key of each named field."""
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key_value")) for f in fields]), lambda e: e["key_value"].isNotNull())
    return df.select(F.explode(entries).alias("__e"), *carry).select("__e.field", "__e.key_value", *carry)


def heavy_keys(df: DataFrame, fields: list[str], share: float, **tree: int) -> DataFrame:
    """(field, key_value, mentions) of the keys that at least ``share`` of all rows of ``df`` hold."""
    counts = tree_aggregate(field_rows(df, fields), ["field", "key_value"], {"mentions": ("count", F.lit(1))}, **tree)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    # One row with one number: its size is fixed.
    part = Fraction(share).limit_denominator(1_000_000)
    return counts.join(F.broadcast(total), F.col("mentions") * part.denominator >= F.col("__total") * part.numerator).drop("__total")
