"""Near-duplicate records with small edits.

An exact similarity join on word sets by a token-group matrix. Texts with the same words form one class. Classes that
share their two rarest words are partitioned into groups, and for each group the union of its members' words is stored:
as the rows of the matrix for the words that can decide a match, and as a bit set of the whole union. A query class is
laid only against the groups that its rarest words name. The words that the query has and the union lacks, and those
that all members have and the query lacks, bound what it can share with any member; only groups that the bound leaves
are opened. Opened members are compared by another bit set and at last by their words, so that no pair is lost and none
is reported that the words don't bear out. Words stand as 32 bits of their hashes; two different words of a pair fall
together about once in thirty million pairs.

Word order (rarest first) comes from a table of counters of fixed size over all words of all texts; it decides speed
only. With similarity s, classes x and y (x no larger) can reach s only if the ``|x| - ceil(2s/(1+s)|x|) + 1`` rarest
words of x meet the ``|y| - ceil(s|y|) + 1`` rarest of y.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.llm.words import WORD
from lodespark.session import cut as checkpointed
from lodespark.session import release

#: Counters of words; the table that is broadcast takes four bytes for each.
COUNTERS = 1 << 20
#: Classes in a group at most, as expected from the counters.
GROUP_CLASSES = 64
#: Rows (class or group with one of its words) in a bucket of the matrix, as expected.
BUCKET_ROWS = 100_000
#: Rows of one word from which they are dealt into slices, every two of which meet in one bucket.
SLICE_ROWS = 20_000
#: Slots of the fixed-size filter of classes that some pair holds.
FILTER = 1 << 20
#: A word in more than this share of texts is left out of the bit sets, where it would tell nothing apart.
COMMON = 0.35
#: Words from which a set has parity bits of its own size besides, as fixed bit sets of large sets are full.
LARGE = 128
#: Query-group cells that are bounded at once.
CELLS = 2_000_000
#: Cells of a word that are bounded in one go, and queries in a run of larger ones.
SMALL_CELLS, RUN = 20_000, 64
#: Roles of a row of the matrix.
QUERY, GROUP = 1, 2

U = np.uint64


def cut(df: DataFrame) -> DataFrame:
    """``df`` cut, and what earlier steps left on the executors' disks let go at once, as it would add up over the steps."""
    out = checkpointed(df)
    del df
    release(out.sparkSession)
    return out


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _word_sets(texts: list[str], memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct words of all texts, one text after the other, and how many each has."""
    flat: list[int] = []
    sizes = []
    for text in texts:
        found = set(WORD.findall(text.lower()))
        sizes.append(len(found))
        flat += map(memo.__getitem__, found)
    return np.array(flat, dtype=U), np.array(sizes, dtype=np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits, so that sums of it tell sets apart."""
    values = (values ^ (values >> U(30))) * U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U(27))) * U(0x94D049BB133111EB)
    return values ^ (values >> U(31))


def _class_numbers(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the class of each set: a digest that does not depend on the order of the words."""
    return _mixed(np.add.reduceat(_mixed(flat), starts) ^ np.bitwise_xor.reduceat(_mixed(flat ^ U(0x9E3779B97F4A7C15)), starts))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _tokenised(texts: DataFrame, wanted=None) -> DataFrame:
    """(id, class, words) of every text with words; a word is the upper half of its hash. ``wanted`` filters classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            flat, sizes = _word_sets(batch.column(1).to_pylist(), memo)
            ids, sizes = batch.column(0).filter(pa.array(sizes > 0)), sizes[sizes > 0]
            if len(sizes):
                classes = _class_numbers(flat, np.cumsum(sizes) - sizes)
                if wanted is not None:
                    kept = wanted.value[(classes % U(FILTER)).astype(np.int64)]
                    ids, classes, flat, sizes = ids.filter(pa.array(kept)), classes[kept], flat[np.repeat(kept, sizes)], sizes[kept]
                yield pa.RecordBatch.from_arrays([ids, _signed(classes), _lists((flat >> U(32)).astype(np.uint32).view(np.int32), sizes)], ["id", "class", "words"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(rows, f"id {kind}, class bigint, words array<int>")


def _counters(tokenised: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold a word of each counter, over all texts, and the number of texts."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = np.zeros(COUNTERS, dtype=np.int64), 0
        for batch in batches:
            table += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
            texts += batch.num_rows
        # Combined within the task already; slot -1 counts the texts.
        slot = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1).astype(np.int32)), pa.array(np.append(table[slot], texts))], ["slot", "n"])

    counted = tokenised.select("words").mapInArrow(slots, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = counted["slot"].to_numpy(), counted["n"].to_numpy()
    table = np.zeros(COUNTERS, dtype=np.int32)
    real = slot >= 0
    table[slot[real]] = np.minimum(n[real], np.iinfo(np.int32).max)
    return table, int(n[~real].sum())


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.ascontiguousarray(flat)))


def _parity(hashes: np.ndarray) -> bytes:
    """Parity bits of a large set, at least as many as it has words."""
    size = 1 << (len(hashes) - 1).bit_length()
    at = hashes & U(size - 1)
    bits = np.zeros(size // 64, dtype=U)
    np.bitwise_xor.at(bits, (at >> U(6)).astype(np.int64), np.left_shift(U(1), at & U(63)))
    return bits.tobytes()


class _Parities:
    """The parity bits of the large sets among the rows of a bucket, kept by their length."""

    def __init__(self, bits: pa.Array) -> None:
        held = bits.to_pylist()
        self.length = np.array([0 if b is None else len(b) // 8 for b in held])
        self.place = np.zeros(len(held), dtype=np.int64)
        self.rows = {}
        for n in np.unique(self.length[self.length > 0]).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.rows[n] = np.frombuffer(b"".join(held[i] for i in at), dtype=U).reshape(-1, n)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words at least stand in one of two large sets only; the longer parity is folded onto the shorter."""
        out = np.zeros(len(x), dtype=np.int64)
        for n, m in np.unique(np.stack([self.length[x], self.length[y]], axis=1), axis=0).tolist():
            at = np.flatnonzero((self.length[x] == n) & (self.length[y] == m))
            short = min(n, m)
            a, b = (np.bitwise_xor.reduce(self.rows[k][self.place[z[at]]].reshape(len(at), -1, short), axis=1) for k, z in ((n, x), (m, y)))
            out[at] = np.bitwise_count(a ^ b).sum(axis=1)
        return out


def _described(tokenised: DataFrame, table, total: int, s: Fraction, slice_rows: int) -> DataFrame:
    """(class, size, own, prefix, slices, gkey, bit sets), once per class.

    ``prefix`` holds the words that can decide a match, rarest first; the first ``own`` of them are those by which the
    class asks. ``slices`` is null unless one of them is so frequent that its rows are dealt into slices.
    """
    common = max(64, int(COMMON * total))
    num, den = s.numerator, s.denominator
    ask_num, ask_den = 2 * num, num + den

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            classes = batch.column(0).to_numpy().view(U)
            flat, sizes = batch.column(1).flatten().to_numpy(), np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            text = np.repeat(np.arange(len(sizes)), sizes)
            df = counts[flat & (COUNTERS - 1)]
            order = np.lexsort((flat, df, text))
            flat, df = flat[order], df[order]
            place = np.arange(len(flat)) - np.repeat(starts, sizes)
            decide = sizes + (-num * sizes) // den + 1
            own = sizes + (-ask_num * sizes) // ask_den + 1
            chosen = place < np.repeat(decide, sizes)
            slices = (df[chosen] // slice_rows + 1).astype(np.int32)
            edges = np.cumsum(decide)
            hot = np.maximum.reduceat(slices, edges - decide) > 1
            dealt = pa.array([slices[e - n : e].tolist() if h else None for e, n, h in zip(edges, decide, hot, strict=True)], pa.list_(pa.int32()))
            mixed = _mixed(flat.view(np.uint32).astype(U))
            # Groups: by the two rarest words, spread where so many texts hold the rarest that a group would be large.
            spread = (df[starts] // GROUP_CLASSES + 1).astype(U)
            gkey = _mixed(mixed[starts] + mixed[np.minimum(starts + 1, ends - 1)] * U(3) + classes % spread)
            bit = np.where(df <= common, np.left_shift(U(1), mixed & U(63)), U(0))
            high = (mixed >> U(6)) & U(1) == 1
            halves = np.where(high, U(0), bit), np.where(high, bit, U(0))
            other = _mixed(mixed + U(1))
            large = pa.array([_parity(other[a:b]) if b - a > LARGE else None for a, b in zip(starts, ends, strict=True)], pa.binary())
            upper, parity = (other >> U(6)) & U(1) == 1, np.left_shift(U(1), other & U(63))
            sets = [np.bitwise_or.reduceat(half, starts) for half in halves]
            sets += [np.bitwise_xor.reduceat(np.where(upper == side, parity, U(0)), starts) for side in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(own.astype(np.int32)), _lists(flat[chosen], decide), dealt, _signed(gkey), *map(_signed, sets), large], ["class", "size", "own", "prefix", "slices", "gkey", "o0", "o1", "x0", "x1", "bits"])

    shape = "class bigint, size int, own int, prefix array<int>, slices array<int>, gkey bigint, o0 bigint, o1 bigint, x0 bigint, x1 bigint, bits binary"
    return tokenised.select("class", "words").mapInArrow(rows, shape).dropDuplicates(["class"])


def _matrix(classes: DataFrame, total: int) -> DataFrame:
    """Rows (bucket, cell, word, role, owner, sizes, bit sets): groups under the words of their union, and queries.

    A group of one class is known by the class and shares its rows with the query. A word too frequent for one bucket
    has its rows dealt into slices; each slice of queries meets each slice of groups in a bucket of its own.
    """
    buckets = max(8, -(-total * 20 // BUCKET_ROWS))
    members = F.collect_list(F.struct("class", "size", "own", "prefix", "slices", "o0", "o1", "bits"))
    bounds = ((F.bit_or, "o0", "o0"), (F.bit_or, "o1", "o1"), (F.bit_and, "o0", "a0"), (F.bit_and, "o1", "a1"))
    groups = classes.groupBy("gkey").agg(members.alias("m"), F.min("size").alias("smallest"), F.max("size").alias("largest"), *(f(c).alias(n) for f, c, n in bounds))
    many, one = F.size("m") > 1, F.get("m", F.lit(0))

    def words_of(m: Column) -> Column:
        return F.transform(m["prefix"], lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get(m["slices"], i), F.lit(1)).alias("slices")))

    def row(role: Column, owner: Column, smallest: Column, largest: Column, bits: Column, sets: list[Column], w: Column) -> Column:
        named = dict(zip(("o0", "o1", "a0", "a1"), sets, strict=True))
        return F.struct(role.cast("byte").alias("role"), owner.alias("owner"), smallest.alias("size"), largest.alias("largest"), *[v.alias(k) for k, v in named.items()], bits.alias("bits"), w["word"].alias("word"), w["slices"].alias("slices"))

    bound_sets = [F.col(n) for _, _, n in bounds]
    union = F.when(many, F.array_distinct(F.flatten(F.transform("m", words_of)))).otherwise(words_of(one))
    both = lambda i: F.when(~many & (i < one["own"]), F.lit(QUERY | GROUP)).otherwise(F.lit(GROUP))
    held = F.transform(union, lambda w, i: row(both(i), F.when(many, F.col("gkey")).otherwise(one["class"]), F.col("smallest"), F.col("largest"), F.when(~many, one["bits"]), bound_sets, w))
    asking = F.flatten(F.transform("m", lambda q: F.transform(F.slice(words_of(q), F.lit(1), q["own"]), lambda w: row(F.lit(QUERY), q["class"], q["size"], q["size"], q["bits"], [q["o0"], q["o1"], q["o0"], q["o1"]], w))))
    rows = groups.select(F.explode(F.when(many, F.concat(held, asking)).otherwise(held)).alias("r")).select("r.*")
    slices = F.col("slices")
    mine = F.pmod(F.xxhash64("owner"), slices).cast("int")

    def dealt(role: int, cell: Callable[[Column], Column]) -> Column:
        cells = F.transform(F.sequence(F.lit(0), slices - 1), lambda other: F.struct(cell(other).alias("cell"), F.lit(role).cast("byte").alias("role")))
        return F.when(F.col("role").bitwiseAND(role) != 0, cells).otherwise(F.array().cast("array<struct<cell:int,role:tinyint>>"))

    single = F.array(F.struct(F.lit(0).alias("cell"), F.col("role").alias("role")))
    cells = F.when(slices == 1, single).otherwise(F.concat(dealt(QUERY, lambda other: mine * slices + other), dealt(GROUP, lambda other: other * slices + mine)))
    rest = ["word", "owner", "size", "largest", "o0", "o1", "a0", "a1", "bits"]
    placed = rows.select(F.explode(cells).alias("c"), *rest).select("c.cell", "c.role", *rest)
    return placed.select(F.pmod(F.xxhash64("word", "cell"), F.lit(buckets)).cast("int").alias("bucket"), "cell", "role", *rest)


def _open(part: pa.Table, s: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query classes, groups, sizes of the queries) of a bucket that the bound leaves."""
    word, cell = part["word"].to_numpy(), part["cell"].to_numpy()
    order = np.lexsort((part["size"].to_numpy(), cell, word))
    word, cell = word[order], cell[order]
    role, owner, size, largest = (part[c].to_numpy()[order] for c in ("role", "owner", "size", "largest"))
    o0, o1, a0, a1 = (part[c].to_numpy()[order].view(U) for c in ("o0", "o1", "a0", "a1"))
    bits = part["bits"].combine_chunks()
    parities = _Parities(bits.take(pa.array(order)))
    large = parities.length > 0
    edges = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (cell[1:] != cell[:-1]), [True]]))
    num, den = s.numerator, s.denominator
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a == 1:
            continue
        queries, groups = a + np.flatnonzero(role[a:b] & QUERY), a + np.flatnonzero(role[a:b] & GROUP)
        if not len(queries) or not len(groups):
            continue
        # Queries and groups go by size, so that a run of queries meets only groups of sizes in its reach.
        step = len(queries) if len(queries) * len(groups) < SMALL_CELLS else max(1, min(RUN, CELLS // len(groups)))
        all_groups, reached = groups, np.maximum.accumulate(largest[groups])
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            groups = all_groups[np.searchsorted(reached, size[q[0]]) : np.searchsorted(size[all_groups], den * size[q[-1]] // num, "right")]
            if not len(groups):
                continue
            g0, g1, h0, h1, low, high = (x[groups][None] for x in (o0, o1, a0, a1, size, largest))
            q0, q1, qs = o0[q][:, None], o1[q][:, None], size[q][:, None]
            apart = np.bitwise_count(q0 & ~g0) + np.bitwise_count(q1 & ~g1) + np.bitwise_count(h0 & ~q0) + np.bitwise_count(h1 & ~q1)
            # The larger side has at most |x| / s words; those in one only are (1 - s) / (1 + s) of both sizes at most.
            largest_match = np.minimum(high, den * qs // num)
            keep = (apart.astype(np.int32) * (den + num) <= (den - num) * (qs + largest_match)) & (high >= qs) & (num * low <= den * qs)
            x, y = np.nonzero(keep)
            x, y = q[x], groups[y]
            if len(both := np.flatnonzero(large[x] & large[y] & (owner[x] != owner[y]))):
                far = (den + num) * parities.apart(x[both], y[both]) > (den - num) * (size[x[both]].astype(np.int64) + size[y[both]])
                stays = np.ones(len(x), dtype=bool)
                stays[both[far]] = False
                x, y = x[stays], y[stays]
            different = owner[x] != owner[y]
            if different.any():
                yield owner[x][different], owner[y][different], size[x][different].astype(np.int64)


def class_links(texts: DataFrame, similarity: float = 0.7, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``texts`` (id, text) as members (id, class) and links (a, b, overlap, together) of classes that are similar.

    A class is a set of words; a link joins two different classes that share at least ``similarity`` of the words found
    in either (``overlap`` of ``together``). Texts that are null or without words, and null ids, belong to no class.
    """
    s = Fraction(similarity).limit_denominator(1000)
    num, den = s.numerator, s.denominator
    context = texts.sparkSession.sparkContext
    texts = texts.where(F.col("text").isNotNull() & F.col("id").isNotNull())
    tokenised = cut(_tokenised(texts))
    counts, total = _counters(tokenised)
    classes = cut(_described(tokenised, context.broadcast(counts), total, s, slice_rows))
    members = cut(tokenised.select("id", "class").distinct())
    del tokenised
    release(texts.sparkSession, rounds=3)
    schema = pa.schema([("a", pa.int64()), ("gid", pa.int64()), ("sa", pa.int64())])

    def opened(part: pa.Table) -> pa.Table:
        found = list(_open(part, s))
        rows = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0) if found else np.empty((0, 3), dtype=np.int64)
        return pa.table([pa.array(rows[:, i]) for i in range(3)], schema=schema)

    candidates = _matrix(classes, total).groupBy("bucket").applyInArrow(opened, "a bigint, gid bigint, sa bigint").distinct()
    # Groups of one class go by the class. The smaller class asks (of equals, the one of smaller number).
    inside = classes.select(F.explode(F.array("gkey", "class")).alias("gid"), F.col("class").alias("b"), F.col("size").alias("sb"), F.col("x0").alias("y0"), F.col("x1").alias("y1"))
    asks = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    pairs = candidates.join(inside, "gid").where(asks & (F.col("sb") * num <= F.col("sa") * den))
    apart = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    pairs = pairs.join(classes.select(F.col("class").alias("a"), "x0", "x1"), "a").where(apart * (den + num) <= (F.col("sa") + F.col("sb")) * (den - num))
    pairs = cut(pairs.select("a", "b").distinct())
    # Only classes in some pair are compared by their words.
    some = pairs.select(F.explode(F.array("a", "b")).alias("c")).select(F.col("c").bitwiseAND(FILTER - 1).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    wanted = np.zeros(FILTER, dtype=bool)
    wanted[some] = True
    held = _tokenised(texts, context.broadcast(wanted)).select("class", "words").dropDuplicates(["class"])
    both = pairs.join(held.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a").join(held.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("overlap"), (F.size("wa") + F.size("wb")).alias("sum"))
    links = both.select("a", "b", "overlap", (F.col("sum") - F.col("overlap")).alias("together")).where(F.col("overlap") * den >= F.col("together") * num)
    return members, links


def similar_pairs(texts: DataFrame, similarity: float = 0.7) -> DataFrame:
    """(id_a, id_b): pairs of different ids, smaller first, whose texts share ``similarity`` of their words.

    Includes ids whose texts have the same words; repeated rows of an id count once. Empty input gives no pairs.
    """
    members, links = class_links(texts, similarity)
    across = links.join(members.select(F.col("id").alias("x"), F.col("class").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("class").alias("b")), "b").select("x", "y")
    same = members.select(F.col("id").alias("x"), "class").join(members.select(F.col("id").alias("y"), "class"), "class").where(F.col("x") < F.col("y")).select("x", "y")
    pair = across.unionByName(same).where(F.col("x") != F.col("y"))
    return pair.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_classes(texts: DataFrame, similarity: float = 0.7) -> DataFrame:
    """(id, class, copies, links): each id with its class of equal word sets, the class' size and its linked classes.

    A class is named by the smallest of its ids. This is the form to use at scale: it has one row per id, while the
    pairs of ids grow with the square of the copies of a text.
    """
    members, links = class_links(texts, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("name"))
    return members.join(sizes, "class").join(degree, "class", "left").select("id", F.col("name").alias("class"), "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
