"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each block of documents (an Arrow batch) is reduced to its distinct words, and only those are encoded: Spark
higher-order functions fold the ranked merges over the byte arrays of the distinct words, looking ranks up in a literal
rank map. The ids of the words are then laid out in the order of the documents. Nothing is shuffled, nothing is sampled
and no vocabulary of the corpus is gathered; the only thing shipped is the tokenizer's rank map, whose size is fixed.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern that splits text before the merges (a fixed value of the vocabulary); (?U) gives white space of Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged with a heap where the block is made, as folding takes time in the square of the length.
FOLD_BYTES = 48
#: Words in a block at most, so that a block of very long documents stays small.
BLOCK_WORDS = 2_000_000
NO_RANK = 2**31 - 1
#: First factor tried and modulus that spread the pairs over the slots of the rank map; a product stays below 2^63.
MIX, PRIME = 2654435, 4294967291


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE: the id of each byte, and the rank and id of each mergeable pair of ids."""

    byte_ids: tuple[int, ...]
    pairs: dict[tuple[int, int], tuple[int, int]]
    pieces: tuple[bytes, ...]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a ``tokenizers`` JSON file; its special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, symbols = model["vocab"], byte_symbols()
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    back = {c: b for b, c in enumerate(symbols)}
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        if all(c in back for c in token):
            pieces[number] = bytes(back[c] for c in token)
    return Vocabulary(tuple(vocab[c] for c in symbols), pairs, tuple(pieces))


def merge_heap(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    """``ids`` with all ranked merges applied, lowest rank first and leftmost among equals, in n log n steps."""
    ids, n = list(ids), len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive, pairs = [True] * n, vocabulary.pairs
    queue = [(pairs[ids[i], ids[i + 1]][0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (ids[i], ids[i + 1]) in pairs]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = pairs[a, b][1], False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (pair := (ids[left], ids[right])) in pairs:
                heapq.heappush(queue, (pairs[pair][0], left, *pair))
    return [x for x, on in zip(ids, alive, strict=True) if on]


@lru_cache(maxsize=4)
def _rank_map(path: str) -> tuple[str, int, int, int]:
    """A literal of the rank map as a perfect hash: SQL of (shifts, keys, ranks, ids), factor, buckets and slots."""
    pairs = load(path).pairs
    keys = np.array([a * 65536 + b for a, b in pairs], dtype=np.int64)
    values = np.array(list(pairs.values()), dtype=np.int64)
    buckets, slots = 16381, 98299
    for mix in range(MIX, MIX + 512, 2):
        groups: list[list[int]] = [[] for _ in range(buckets)]
        mixed = keys * mix % PRIME
        for i, k in enumerate((mixed % buckets).tolist()):
            groups[k].append(i)
        home = (mixed % slots).tolist()
        taken, shifts = [-1] * slots, np.zeros(buckets, dtype=np.int64)
        for bucket in sorted(range(buckets), key=lambda g: -len(groups[g])):
            members = groups[bucket]
            if not members:
                continue
            if len({home[i] for i in members}) < len(members):
                break
            for shift in range(slots):
                at = [(home[i] + shift) % slots for i in members]
                if all(taken[p] < 0 for p in at):
                    for p, i in zip(at, members, strict=True):
                        taken[p] = i
                    shifts[bucket] = shift
                    break
            else:
                break
        else:
            break
    else:
        raise ValueError("no perfect hash found")
    taken = np.array(taken)
    filled = taken >= 0
    held = np.where(filled, keys[taken], -1), np.where(filled, values[taken, 0], NO_RANK), np.where(filled, values[taken, 1], -1)
    arrays = [f"cast(split('{','.join(map(str, a.tolist()))}', ',') as array<{t}>)" for a, t in ((shifts, "int"), (held[0], "bigint"), (held[1], "int"), (held[2], "int"))]
    return f"array(named_struct('shifts', {arrays[0]}, 'keys', {arrays[1]}, 'ranks', {arrays[2]}, 'ids', {arrays[3]}))", mix, buckets, slots


def fold_merges(symbols: Column, path: str) -> Column:
    """ARRAY<ARRAY<INT>> of byte ids of words as the ids that the ranked merges leave of each word.

    The state of the fold is the word's ids with the rank of each neighbouring pair. A step merges the first pair of
    the lowest rank and looks up the two pairs that this makes; a word of n bytes takes n - 1 steps at most.
    """
    literal, mix, buckets, slots = _rank_map(path)
    none = F.lit(NO_RANK)

    def encode(table: Column, word: Column) -> Column:
        def slot(a: Column, b: Column) -> tuple[Column, Column]:
            key = a.cast("bigint") * 65536 + b
            mixed = key * mix % PRIME
            return key, ((mixed % slots + F.get(table["shifts"], (mixed % buckets).cast("int"))) % slots).cast("int")

        def rank(a: Column, b: Column) -> Column:
            key, at = slot(a, b)
            return F.coalesce(F.when(F.get(table["keys"], at) == key, F.get(table["ranks"], at)), none)

        def merged(a: Column, b: Column) -> Column:
            return F.get(table["ids"], slot(a, b)[1])

        def step(state: Column, _: Column) -> Column:
            ids, ranks = state["ids"], state["ranks"]
            p = state["at"]  # 1-based place of the pair to merge

            def join(new: Column) -> Column:
                left, right = F.get(ids, p - 2), F.get(ids, p + 1)
                made = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(new), F.slice(ids, p + 2, F.size(ids)))
                around = F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), F.when(p > 1, F.array(rank(left, new))).otherwise(F.array().cast("array<int>")), F.when(p + 1 < F.size(ids), F.array(rank(new, right))).otherwise(F.array().cast("array<int>")), F.slice(ranks, p + 2, F.size(ids)))
                return _state(made, around)

            done = F.transform(F.array(merged(F.get(ids, p - 1), F.get(ids, p))), join)
            return F.when(p > 0, F.get(done, 0)).otherwise(state)

        def _state(ids: Column, ranks: Column) -> Column:
            low = F.array_min(ranks)
            return F.struct(ids.alias("ids"), ranks.alias("ranks"), F.when(low < none, F.array_position(ranks, low).cast("int")).otherwise(F.lit(0)).alias("at"))

        n = F.size(word)
        ranks = F.zip_with(F.slice(word, F.lit(1), n - 1), F.slice(word, F.lit(2), n - 1), rank)
        folded = F.aggregate(F.sequence(F.lit(1), n - 1), _state(word, ranks), step, lambda s: s["ids"])
        return F.when((n < 2) | (n > FOLD_BYTES), word).otherwise(folded)

    return F.get(F.transform(F.expr(literal), lambda table: F.transform(symbols, lambda word: encode(table, word))), 0)


def _block_maker(vocabulary: Vocabulary):
    table = np.array(vocabulary.byte_ids, dtype=np.int32)

    def block(keys: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
        flat = words.flatten().dictionary_encode()
        flat = flat if isinstance(flat, pa.DictionaryArray) else flat.combine_chunks()
        texts = flat.dictionary.cast(pa.large_binary())
        lengths = np.array(pc.binary_length(texts))
        symbols = table[np.frombuffer(b"".join(texts.to_pylist()), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        long = np.flatnonzero(lengths > FOLD_BYTES)
        if len(long):
            parts, last = [], 0
            for i in long:
                parts += [symbols[last : ends[i] - lengths[i]], np.array(merge_heap(symbols[ends[i] - lengths[i] : ends[i]].tolist(), vocabulary), dtype=np.int32)]
                lengths[i], last = len(parts[-1]), ends[i]
            symbols = np.concatenate([*parts, symbols[last:]])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(symbols))

        def one(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        sizes = pc.list_value_length(words).cast(pa.int32())
        return pa.RecordBatch.from_arrays([one(keys), one(sizes), one(flat.indices.cast(pa.int32())), one(held)], ["keys", "sizes", "codes", "symbols"])

    return block


def _plain(array: pa.Array) -> pa.ListArray:
    """A list array with 32-bit offsets, starting at 0."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(array).to_numpy(zero_copy_only=False))]).astype(np.int32)), array.flatten())


def encode(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of every text by the vocabulary at ``path``, without special tokens.

    Null and empty texts give the empty list; text that looks like a special token is ordinary text. All rows come out,
    repeated ones and those with a null key too.
    """
    vocabulary = load(path)
    kind = docs.schema[key].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _block_maker(vocabulary)
        for batch in batches:
            words = _plain(batch.column(1))
            offsets = words.offsets.to_numpy()
            start = 0
            while start < len(words):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK_WORDS, "right")) - 1)
                yield make(batch.column(0)[start:stop], _plain(words[start:stop]))
                start = stop

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sizes, codes, held = (batch.column(i)[row].values for i in range(4))
                held = _plain(held)
                lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False)
                codes = codes.to_numpy(zero_copy_only=False)
                starts, counts = held.offsets.to_numpy()[:-1][codes], lengths[codes]
                ends = np.cumsum(counts)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
                ids = held.values.to_numpy(zero_copy_only=False)[at].astype(np.int32)
                edges = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int64)
                offsets = np.concatenate([[0], ends])[edges].astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["k", "ids"])

    content = F.col(text)
    words = F.when(F.length(content) > 0, F.regexp_extract_all(content, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    blocked = docs.select(F.col(key).cast("string").alias("k"), words.alias("words")).mapInArrow(blocks, "keys array<string>, sizes array<int>, codes array<int>, symbols array<array<int>>")
    folded = blocked.select("keys", "sizes", "codes", fold_merges(F.col("symbols"), path).alias("symbols"))
    return folded.mapInArrow(lay_out, "k string, ids array<int>").select(F.col("k").cast(kind).alias(key), "ids")


def decode(ids: Column, path: str) -> Column:
    """The text of token ids: the binary pieces of the ids, concatenated. Null ids give null."""
    pieces = ",".join(p.hex() for p in load(path).pieces)
    table = F.expr(f"array(split('{pieces}', ','))")
    joined = F.get(F.transform(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")), 0)
    return F.decode(F.unhex(joined), "utf-8")
