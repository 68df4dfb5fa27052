"""Evaluation texts leaking into training text.

The n-grams of the test items form a hash set that is broadcast, and each document's token windows are scanned against
it. A document is first reduced to one flag per word (does the word occur in any item?), so that only stretches of at
least ``n`` such words are windowed. The set holds the word tuples themselves: a hit is verified by equality.

Item tables too large for one set are met in another way, with one scan of the corpus whatever their number: windows of
both sides are hashed, a Bloom filter of the items' hashes (of bounded size) is broadcast and leaves few windows of the
corpus, these are joined to the items by hash, and a hit is verified by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.words import WORD, words
from lodespark.session import cut

#: Items and characters of item text in one broadcast set; larger item tables are joined by hash.
MAX_ITEMS = 20_000
MAX_CHARS = 32_000_000
#: Bits of the Bloom filter at most (a fuller one leaves more windows to the join and loses none), and positions per window.
MAX_BITS = 1 << 29
PROBES = 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class NgramSet:
    """The n-grams of a block of items, by word tuple, and the words they consist of."""

    n: int
    items: dict[tuple[str, ...], list[int]] = field(default_factory=dict)
    vocabulary: set[str] = field(default_factory=set)

    def add(self, item: object, text: str | None) -> None:
        tokens = words(text)
        for i in range(len(tokens) - self.n + 1):
            held = self.items.setdefault(tuple(tokens[i : i + self.n]), [])
            if item not in held:
                held.append(item)
            self.vocabulary.update(tokens[i : i + self.n])

    def hits(self, tokens: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(place of the window, items) of every window of ``tokens`` in the set."""
        n, known = self.n, bytes(map(self.vocabulary.__contains__, tokens))
        start = known.find(b"\x01" * n)
        while start >= 0:
            end = known.find(b"\x00", start)
            end = len(known) if end < 0 else end
            for i in range(start, end - n + 1):
                if held := self.items.get(tuple(tokens[i : i + n])):
                    yield i, held
            start = known.find(b"\x01" * n, end)


def _sizes(items: DataFrame, texts: list[str]) -> tuple[int, int]:
    """The number of items and of characters of their texts."""
    chars = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("c")).first()
    return size["n"], size["c"]


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def window_hashes(tokens: list[str], n: int, memo: _Hashes) -> np.ndarray:
    """A hash of every ``n`` consecutive words, in order."""
    if len(tokens) < n:
        return np.empty(0, dtype=np.uint64)
    words = np.array([memo[t] for t in tokens], dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _MULTIPLIER + words[i : i + len(out)]
    out ^= out >> np.uint64(31)
    return out * _MULTIPLIER


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((hashes >> np.uint64(11 * i)) ^ (hashes << np.uint64(7 * i))) & np.uint64(bits - 1) for i in range(PROBES)]


def _joined(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, texts: list[str], n: int, chars: int) -> DataFrame:
    """As ``_scan`` for item tables of any size, by one scan of the corpus and a join of the windows that the filter leaves."""
    kind, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            hashes, rows, told = [], [], []
            for column in batch.columns[1:]:
                for row, given in enumerate(column.to_pylist()):
                    tokens = words(given)
                    found = window_hashes(tokens, n, memo)
                    hashes.append(found)
                    rows += [row] * len(found)
                    told += [" ".join(tokens[i : i + n]) for i in range(len(found))]
            flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(told, pa.string())], ["h", "item_id", "gram"])

    held = cut(items.select(item_id, *texts).mapInArrow(grams, f"h bigint, item_id {item_type}, gram string").distinct())
    # A window takes a character a word at least.
    bits = min(MAX_BITS, max(1 << 10, 1 << (8 * min(held.count(), chars)).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)))
            cell, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(cell):
                value = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(value.view(np.int64))], ["cell", "bits"])

    filled = held.select("h").mapInArrow(marked, "cell int, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(max(1, bits >> 6), dtype=np.uint64)
    table[filled["cell"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = _Hashes(), shared.value
        for batch in batches:
            rows, hashes, at, told = [], [], [], []
            for row, content in enumerate(batch.column(2).to_pylist()):
                tokens = WORD.findall(content.lower())
                found = window_hashes(tokens, n, memo)
                stays = np.ones(len(found), dtype=bool)
                for place in _places(found, bits):
                    stays &= (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                for i in np.flatnonzero(stays).tolist():
                    rows.append(row)
                    hashes.append(found[i])
                    at.append(i)
                    told.append(" ".join(tokens[i : i + n]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(at, pa.int32()), pa.array(told, pa.string())], ["row", "k", "h", "at", "gram"])

    # Rows are told apart by their place, as keys may repeat.
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    left = given.mapInArrow(windows, "row bigint, k string, h bigint, at int, gram string")
    hits = left.join(held, ["h", "gram"]).groupBy("row", "item_id").agg(F.first("k").alias("k"), F.array_sort(F.collect_set("at")).alias("windows"))
    return hits.select(F.col("k").cast(kind).alias(key), "item_id", "windows")


def _scan(docs: DataFrame, key: str, text: str, grams: NgramSet, item_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            for place, content in enumerate(batch["t"]):
                if content is not None:
                    found: dict[object, list[int]] = {}
                    for i, held in known.hits(WORD.findall(content.lower())):
                        for item in held:
                            found.setdefault(item, []).append(i)
                    rows += [(place, item, at) for item, at in found.items()]
            keys = batch["k"].iloc[[r[0] for r in rows]].reset_index(drop=True)
            yield pd.DataFrame({"k": keys, "item_id": pd.Series([r[1] for r in rows], dtype="object"), "windows": pd.Series([r[2] for r in rows], dtype="object")})

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return given.mapInPandas(scan, f"k string, item_id {item_type}, windows array<int>").select(F.col("k").cast(kind).alias(key), "item_id", "windows")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_texts: list[str], n: int = 12) -> DataFrame:
    """(key, item_id, windows): documents that hold ``n`` consecutive words of one of an item's texts.

    ``windows`` are the places of the first words of the windows found. Each text of an item is windowed by itself.
    Null, empty and short texts, in documents or items, give nothing; items sharing a text are all reported; repeated
    documents are reported each; an empty table gives an empty result. Further columns are not read.
    """
    count, chars = _sizes(items, item_texts)
    if count > MAX_ITEMS or chars > MAX_CHARS:
        return _joined(docs, key, text, items, item_id, item_texts, n, chars)
    grams = NgramSet(n)
    for row in items.select(item_id, *item_texts).toLocalIterator():
        for given in row[1:]:
            grams.add(row[0], given)
    return _scan(docs, key, text, grams, items.schema[item_id].dataType.simpleString())


def remove_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_texts: list[str], n: int = 12) -> DataFrame:
    """(key, spans, clean): affected documents with every leaked span of words cut out of the text."""
    kind = docs.schema[key].dataType.simpleString()
    places = leaks(docs, key, text, items, item_id, item_texts, n).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, content, windows in zip(batch["k"], batch["t"], batch["windows"], strict=True):
                # Lower-casing can lengthen a text; the spans are then taken on the lower-cased text.
                base = content if len(content.lower()) == len(content) else content.lower()
                spots = [m.span() for m in WORD.finditer(base.lower())]
                spans: list[list[int]] = []
                for w in windows:
                    begin, end = spots[w][0], spots[w + n - 1][1]
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([begin, end])
                edges = [0, *(x for s in spans for x in s), len(base)]
                out.append((k, len(spans), "".join(base[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            yield pd.DataFrame(out, columns=["k", "spans", "clean"])

    texts = docs.select(key, F.col(text).alias("t"))
    joined = texts.join(places, key).select(F.col(key).cast("string").alias("k"), "t", "windows")
    return joined.mapInPandas(clean, "k string, spans int, clean string").select(F.col("k").cast(kind).alias(key), "spans", "clean")
