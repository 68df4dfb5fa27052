"""Variant spellings of names typed by people.

Suffix blocking: every token of a name is indexed under its shortest suffix of at least ``MIN_SUFFIX`` characters that
is not overly common. Before an overly common suffix is given up it is refined with other fields: the letters of the
name's other main token and whether it names an organisation; in names of persons the other token counts as typed, as
the full forms of a short form and by its initial, and tokens too short for a suffix are refined in the same way. Pairs
within a block are compared token by token by the ratio of their longest common subsequence, with initials, short
forms, titles, abbreviations, acronyms, middle names and reordered parts allowed for. A block that is still large is
dealt into slices, every two of which meet in a cell of their own, so that no pair is lost and no task sees more than
two slices. Links are closed to entities by connected components; a bare initial or an acronym joins an entity only if
it fits one alone.

Which first names are forms of one name is known in three ways: by rule (a short form is a part of the full one, perhaps
with a pet ending), for the few common irregular ones from a list, and from the names themselves: a form that is found
mostly with the same rare surnames as one other first name stands for it. First names that differ by a gendered ending
are different, and so are first names that are both established in their own right.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import cut

MIN_SUFFIX = 4
#: Longer suffixes tell no more names apart.
MAX_SUFFIX = 32
#: Names that a suffix may hold before it is overly common.
BLOCK_NAMES = 128
#: Counters of suffixes: a table of fixed size.
COUNTERS = 1 << 20
#: Share of names from which a token is common: a common token is no misspelling of another. At most a few thousand.
COMMON_SHARE = 0.002
SIMILAR = 0.8
SIMILAR_FIRST = 0.76
#: Names expected in a bucket of blocks.
BUCKET_NAMES = 20_000
#: Names of a block from which it is dealt into slices.
SLICE_NAMES = 1_500
#: Names of a block up to which they are compared pair by pair.
SMALL_BLOCK = 48
#: A surname tells of first names if at most this many different ones are found with it.
RARE_FIRSTS = 12
#: A first name is learned as a form of another if it shares at least this many rare surnames with it, and this share of its own.
SUPPORT, CONFIDENCE = 2, 0.5
#: Rare surnames by which a first name is established, and the share of them with any one other name up to which it stands for itself.
ESTABLISHED, ALONE = 5, 0.15
#: Parts of a person's name, particles left out, at most.
MAX_PARTS = 5

# Spellings of the entity types, titles, legal forms, abbreviations and pet names.
PERSON_TYPES = ("PERSON", "PEOPLE", "INDIVIDUAL", "HUMAN")
ORGANISATION_TYPES = ("ORG", "ORGANIZATION", "ORGANISATION", "INSTITUTION", "AGENCY", "COMPANY")
TITLES = frozenset("sir dame lord lady dr prof professor doctor mr mrs ms miss rev reverend jr sr".split())
LEGAL = frozenset("ltd limited inc incorporated llc plc gmbh".split())
SMALL = frozenset("the of for and in".split())
ABBREVIATIONS = {
    "univ": "university", "uni": "university", "inst": "institute", "corp": "corporation", "assoc": "association", "assn": "association",
    "lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories", "soc": "society", "dept": "department", "dep": "department",
    "mus": "museum", "intl": "international", "int": "international", "co": "company", "comp": "company", "natl": "national", "fdn": "foundation", "cncl": "council",
}
ORGANISATION_WORDS = frozenset(ABBREVIATIONS.values()) | {"academy", "works", "trust", "college", "school", "bank", "union", "agency", "ministry"}
PARTICLES = frozenset("van von der den de del della di da la le du dos das ter ten bin ibn al el".split())
#: Common English short forms that are no part of the full name, with the full names (fixed values; others are learned).
IRREGULAR = {
    "bob": "robert", "bobby": "robert", "bill": "william", "billy": "william", "dick": "richard", "rick": "richard", "ted": "edward theodore", "teddy": "edward theodore", "ned": "edward",
    "jack": "john", "jim": "james", "jimmy": "james", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "polly": "mary", "molly": "mary", "sally": "sarah", "nancy": "ann anne", "hank": "henry",
    "harry": "henry harold", "hal": "henry harold", "chuck": "charles", "tony": "anthony", "betty": "elizabeth", "bess": "elizabeth", "libby": "elizabeth", "kit": "christopher katherine", "steve": "stephen",
    "jerry": "gerald", "babs": "barbara", "sandy": "alexander", "larry": "lawrence", "dot": "dorothy", "dolly": "dorothy", "nell": "eleanor helen", "mick": "michael", "kate": "catherine katherine", "kathy": "catherine katherine",
}
#: Endings by which a first name of one sex is made from one of the other, and those that are exchanged (fixed values).
GENDER_ADDED = ("a", "e", "la", "le", "na", "ne", "ia", "ina", "ine", "ella", "elle", "etta", "ette")
GENDER_SWAPPED = (("o", "a"), ("us", "a"), ("us", "ia"), ("io", "ia"))
PET_ENDINGS = ("ie", "y", "ey", "i", "ee", "o", "s")
_SPLIT = re.compile(r"[^\w]+|_+")


def _plain(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return plain.replace("'", "").replace("’", "")


def tokens(text: str) -> tuple[str, ...]:
    """The telling tokens of a name: unaccented small letters, abbreviations spelt out, titles and legal forms left out.

    What stands behind a single comma is put in front. A word of two to six capitals, with or without points, may be an
    acronym: its token begins with "=".
    """
    letters = re.sub(r"[.\s]", "", text)
    if 2 <= len(letters) <= 6 and letters.isalpha() and letters.isupper() and (len(text.split()) == 1 or "." in text):
        return (f"={_plain(letters)}",)
    parts = _plain(text).split(",")
    given = f"{parts[1]} {parts[0]}" if len(parts) == 2 else " ".join(parts)
    found = [ABBREVIATIONS.get(t, t) for t in _SPLIT.split(given) if t]
    return tuple(t for t in found if t not in TITLES and t not in LEGAL and t not in SMALL) or tuple(found)


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        kept = row & masks.get(c, 0)
        row = (row + kept) | (row - kept)
    return len(a) - (row & full).bit_count()


@lru_cache(maxsize=1 << 18)
def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b))


def gendered(a: str, b: str) -> bool:
    """Whether two first names differ by a gendered ending, as Robert and Roberta or Mario and Maria."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= 3 and any(long == short + e for e in GENDER_ADDED):
        return True
    return any(min(len(a), len(b)) > len(x) + 1 and ((a.endswith(x) and b.endswith(y) and a[: -len(x)] == b[: -len(y)]) or (b.endswith(x) and a.endswith(y) and b[: -len(x)] == a[: -len(y)])) for x, y in GENDER_SWAPPED)


@lru_cache(maxsize=1 << 16)
def stems(name: str) -> tuple[str, ...]:
    """A first name as it may be part of a longer one: as it is, and without a pet ending, the doubled letter before it and the k of ck."""
    out = [name]
    for e in PET_ENDINGS:
        if name.endswith(e) and len(name) - len(e) >= 2:
            stem = name[: -len(e)]
            out.append(stem)
            if len(stem) > 2 and stem[-1] == stem[-2]:
                out.append(stem[:-1])
    out += [stem[:-1] for stem in out if len(stem) > 3 and stem.endswith("ck")]
    return tuple(dict.fromkeys(out))


def shortened(short: str, full: str) -> bool:
    """Whether ``short`` is a part of ``full`` by rule: its beginning, its end, or, with a pet ending, from within it."""
    if len(full) < 4 or len(short) >= len(full) + 1 or short == full:
        return False
    for stem in stems(short):
        pet = stem != short
        if len(stem) >= len(full) or (len(stem) == 2 and not (pet or len(short) == 2)):
            continue
        if len(stem) >= 2 and full.startswith(stem) and (pet or len(full) - len(stem) >= 2):
            return True
        if len(stem) >= 4 and full.endswith(stem) or len(stem) >= 3 and stem in full[1:-1] and (pet or len(stem) == 3 and stem not in full[-3:]):
            return True
    return False


@dataclass(frozen=True)
class FirstNames:
    """What the names themselves tell of first names: full names by form, and names that stand for themselves."""

    fulls: dict[str, frozenset[str]] = field(default_factory=dict)
    own: frozenset[str] = frozenset()

    @classmethod
    def of(cls, told: Iterable[str]) -> FirstNames:
        """From what ``learn_first_names`` tells: a form with its full names behind it, or a name alone that stands for itself."""
        words = [t.split(" ") for t in told]
        return cls({w[0]: frozenset(w[1:]) for w in words if len(w) > 1}, frozenset(w[0] for w in words if len(w) == 1))

    def full(self, name: str) -> frozenset[str]:
        learned = self.fulls.get(name)
        listed = IRREGULAR.get(name)
        return (learned or frozenset()) | frozenset(listed.split() if listed else ())


@lru_cache(maxsize=1 << 16)
def organisation_word(token: str) -> str | None:
    """The word for a kind of organisation that a token is but for a letter or so."""
    return next((w for w in sorted(ORGANISATION_WORDS) if len(w) > 5 and w[0] == token[0] and abs(len(w) - len(token)) <= 1 and ratio(w, token) >= 0.9), None)


class Matcher:
    """Compares names, knowing which tokens are common and what was learned of first names."""

    def __init__(self, common: frozenset[str], first: FirstNames = FirstNames()) -> None:
        self.common, self.first = common, first
        self.first_names = lru_cache(maxsize=1 << 18)(self._first_names)

    def similar(self, a: str, b: str, least: float = SIMILAR) -> bool:
        if a == b:
            return True
        if abs(len(a) - len(b)) > 3 or min(len(a), len(b)) < 4 or a.isdigit() or b.isdigit() or (a in self.common and b in self.common):
            return False
        return ratio(a, b) >= least

    def _first_names(self, a: str, b: str) -> bool:
        if a == b:
            return True
        full_a, full_b = self.first.full(a), self.first.full(b)
        if len(a) == 1 or len(b) == 1:
            return bool({a[0], *(f[0] for f in full_a)} & {b[0], *(f[0] for f in full_b)})
        if b in full_a or a in full_b or full_a & full_b or any(shortened(b, f) for f in full_a) or any(shortened(a, f) for f in full_b):
            return True
        if gendered(a, b) or (a in self.first.own and b in self.first.own):
            return False
        if (a not in self.first.own and shortened(a, b)) or (b not in self.first.own and shortened(b, a)):
            return True
        return self.similar(a, b, SIMILAR_FIRST)

    def organisation(self, name: tuple[str, ...]) -> bool:
        return len(name) >= 3 and any(t in ORGANISATION_WORDS or organisation_word(t) or (t not in self.common and any(self.similar(t, w) for w in ORGANISATION_WORDS if w[0] == t[0] or w[-1] == t[-1])) for t in name)

    def shape(self, name: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        """What a name is compared as: an acronym, an organisation, a person (without particles) or other."""
        if name[0][0] == "=":
            return "acronym", name
        if self.organisation(name):
            # A slip in a word that many organisations have tells nothing apart.
            return "organisation", tuple(organisation_word(t) or t for t in name)
        parts = person(name)
        return ("other", name) if parts is None else ("person", parts)

    def same(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        """Whether two names, given by their tokens, may name one person or organisation."""
        return self.same_shapes(self.shape(a), self.shape(b))

    def same_shapes(self, a: tuple[str, tuple[str, ...]], b: tuple[str, tuple[str, ...]]) -> bool:
        if a[0] == "acronym" or b[0] == "acronym":
            return (a[1] == b[1]) if a[0] == b[0] else f"={initials(a[1])}" == b[1][0] if b[0] == "acronym" else f"={initials(b[1])}" == a[1][0]
        if a[0] != b[0]:
            return False
        if a[0] == "person":
            return self._same_person(a[1], b[1])
        return a[0] == "organisation" and len(a[1]) == len(b[1]) and self._same_tokens(a[1], b[1])

    def _same_tokens(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        left, right = list(a), list(b)
        for t in a:
            if t in right:
                left.remove(t)
                right.remove(t)
        for t in left:
            best = max((ratio(t, u), u) for u in right)[1]
            if not self.similar(t, best):
                return False
            right.remove(best)
        return True

    def _surnames(self, a: str, b: str) -> bool:
        # Short parts tell too little to allow for errors, and short forms of first names are no surnames.
        return self.similar(a, b) if len(a) >= MIN_SUFFIX else len(a) > 1 and a == b and not self.first.full(a)

    def _same_person(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        # Names of two parts may be reordered; in longer ones the surname stands last.
        ways = ((-1, -1), (0, 0), (-1, 0), (0, -1)) if len(a) == len(b) == 2 else ((-1, -1), (0, -1)) if len(a) == 2 else ((-1, -1), (-1, 0)) if len(b) == 2 else ((-1, -1),)
        for p, q in ways:
            # A first part is as likely a first name.
            if self._surnames(a[p], b[q]) and (p == q == -1 or not gendered(a[p], b[q])) and self._given(a[:-1] if p else a[1:], b[:-1] if q else b[1:]):
                return True
        return False

    def _given(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        """First names alike, and the middle names of one among those of the other in order."""
        if not self.first_names(a[0], b[0]):
            return False
        few, many = (a[1:], b[1:]) if len(a) <= len(b) else (b[1:], a[1:])
        at = iter(many)
        return all(any(self.first_names(x, y) for y in at) for x in few)


def initials(name: tuple[str, ...]) -> str:
    return "".join(t[0] for t in name) if len(name) >= 3 else ""


def person(name: tuple[str, ...]) -> tuple[str, ...] | None:
    """The parts of a person's name, particles left out, of which at least one is no initial; None for other names."""
    parts = tuple(t for t in name if t not in PARTICLES) if len(name) > 2 else name
    long = sum(len(t) > 1 for t in parts)
    return parts if 2 <= len(parts) <= MAX_PARTS and long >= 1 and not any(t.isdigit() for t in parts) and (len(parts) == 2 or len(parts[-1]) > 1) else None


def bare(name: tuple[str, ...]) -> bool:
    """Whether a name is an acronym or has only initials beside one token."""
    return name[0][0] == "=" or (len(name) >= 2 and sum(len(t) > 1 for t in name) <= 1)


def fields(other: str, first: FirstNames, wide: bool) -> tuple[set[str], set[str]]:
    """What refines a block of persons: letters of the other token, as typed and in full, and its possible initials.

    ``wide`` takes all letters in which a short form may be part of it.
    """
    full = first.full(other)
    letters = {f"<{s[:2]}" for s in stems(other) if len(s) == 2} | {f"<{other[:2]}"} | {s[:3] for s in stems(other) if len(s) > 2} | {f[:3] for f in full}
    if len(other) > 1:
        letters |= {other[-3:], other[:1] + other[-1:]}
    if wide:
        letters |= {other[i : i + 3] for i in range(len(other) - 2)}
    return letters, {other[0], *(f[0] for f in full)}


def block_keys(name: tuple[str, ...], counts: np.ndarray, is_organisation: bool, first: FirstNames = FirstNames()) -> list[int]:
    """The blocks of a name: per token its shortest suffix that is not overly common, and refinements of common ones.

    Odd keys are of blocks by initial or acronym, in which only bare names are compared with others.
    """
    if name[0][0] == "=":
        return [_key(f"acronym|{name[0]}", True)]
    out = []
    is_person = not is_organisation and person(name) is not None
    for i, token in enumerate(name):
        refined = []
        # Read backwards too, so that an error near its end spoils only one of a token's blocks.
        for way in (token, token[::-1]) if len(token) >= MIN_SUFFIX else ():
            for size in range(MIN_SUFFIX, min(len(way), MAX_SUFFIX) + 1):
                if counts[_slot(way[-size:])] <= BLOCK_NAMES:
                    out.append(_key(way[-size:]))
                    break
            if counts[_slot(way[-MIN_SUFFIX:])] > BLOCK_NAMES:
                refined.append(way[-MIN_SUFFIX:])
        if is_person and 1 < len(token) < MIN_SUFFIX and token not in IRREGULAR:
            refined.append(token)
        if not refined:
            continue
        others = [t for j, t in enumerate(name) if j != i and not (is_organisation and t in ORGANISATION_WORDS) and t not in PARTICLES]
        # Of three or more parts of a person's name the first and the last may stand without the others.
        mains = [max(others, key=lambda t: (len(t), t), default="")] if not is_person or len(name) == 2 else [t for t in dict.fromkeys((others[0], others[-1])) if others]
        for other in mains:
            if is_person and other:
                wide = len(other) < MIN_SUFFIX or counts[_slot(other[-MIN_SUFFIX:])] > BLOCK_NAMES
                letters, by_initial = fields(other, first, wide)
            else:
                letters, by_initial = {other[:3], other[-3:], other[:1] + other[-1:]}, set()
            for part in refined:
                out += [_key(f"{part}|{is_organisation}|{letter}") for letter in letters]
                out += [_key(f"{part}|{letter}", True) for letter in by_initial]
    if letters := initials(name):
        out.append(_key(f"acronym|={letters}", True))
    return list(dict.fromkeys(out))


def _key(block: str, by_initial: bool = False) -> int:
    return xxhash.xxh64_intdigest(block) & ~1 | by_initial


def _slot(suffix: str) -> int:
    return xxhash.xxh64_intdigest(suffix, seed=7) % COUNTERS


def _counts(names: DataFrame) -> tuple[np.ndarray, int]:
    """How many names hold a suffix of each counter, and the number of names."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for name in batch.column(0).to_pylist() for s in {_slot(w[-n:]) for t in name for w in (t, t[::-1]) for n in range(MIN_SUFFIX, min(len(t), MAX_SUFFIX) + 1)}]
            slot, n = np.unique(np.array(found, dtype=np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1).astype(np.int32)), pa.array(np.append(n, batch.num_rows).astype(np.int64))], ["slot", "n"])

    counted = names.select("tokens").mapInArrow(slots, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = counted["slot"].to_numpy(), counted["n"].to_numpy()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[slot[slot >= 0]] = n[slot >= 0]
    return table, int(n[slot < 0].sum())


def names_of(traces: DataFrame, text: str, kind: str) -> DataFrame:
    """(text, tokens): the distinct texts on rows whose type means person or organisation; no null or blank texts."""
    wanted = F.upper(F.trim(kind)).isin(*PERSON_TYPES, *ORGANISATION_TYPES)

    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: list(tokens(t)))

    distinct = traces.where(wanted & (F.trim(text) != "")).select(F.col(text).alias("text")).distinct()
    return distinct.select("text", split("text").alias("tokens")).where(F.size("tokens") > 0)


def heads_of(names: DataFrame) -> DataFrame:
    """(text, tokens, name): the smallest text of each set of tokens; the others of a set name the same as it."""
    keyed = names.withColumn("name", F.array_join(F.array_sort("tokens"), " "))
    return keyed.groupBy("name").agg(F.min(F.struct("text", "tokens")).alias("h")).select("h.text", "h.tokens", "name")


def learn_first_names(heads: DataFrame) -> DataFrame:
    """(token, told): first names by their rare surnames, over all names of two parts, of which the last is mostly the surname.

    ``told`` is the name with the full names it is a form of behind it, or the name alone if it is established in its own
    right. The number of surnames that tell of a name does not grow with the number of names.
    """
    both = heads.where((F.size("tokens") == 2) & F.forall("tokens", lambda t: F.length(t) > 1)).select(F.col("tokens")[1].alias("s"), F.col("tokens")[0].alias("f")).distinct()
    rare = both.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= RARE_FIRSTS).select("s")
    kept = cut(both.join(rare, "s").groupBy("s").agg(F.array_sort(F.collect_set("f")).alias("fs")))
    surnames = kept.count()
    singles = kept.select(F.explode("fs").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    pairs = kept.select(F.explode("fs").alias("p"), "fs").select("p", F.explode("fs").alias("f")).where("p <> f").groupBy("p", "f").agg(F.count(F.lit(1)).alias("co"))
    known = singles.join(pairs, "p", "left").join(singles.select(F.col("p").alias("f"), F.col("n").alias("m")), "f", "left")
    # A form is rarer than its full name, and the two are together far more often than by chance.
    form = (F.col("co") >= SUPPORT) & (F.col("co") >= CONFIDENCE * F.col("n")) & (F.col("m") > F.col("n")) & (F.col("co") * float(max(1, surnames)) >= 5.0 * F.col("n") * F.col("m"))
    summed = known.groupBy("p", "n").agg(F.max(F.coalesce("co", F.lit(0))).alias("most"), F.collect_set(F.when(form, F.col("f"))).alias("fulls"))
    told = summed.where((F.size("fulls") > 0) | ((F.col("n") >= ESTABLISHED) & (F.col("most") <= ALONE * F.col("n"))))
    return told.select(F.col("p").alias("token"), F.concat_ws(" ", "p", F.array_sort("fulls")).alias("told"))


def with_told(heads: DataFrame, told: DataFrame) -> DataFrame:
    """(text, tokens, told): names with what ``told`` (token, told) has of their tokens, null if it has nothing.

    It goes with the names instead of to every executor, as the number of first names has no bound.
    """
    # Only persons are asked about, and their names have few parts.
    few = heads.where(F.size(F.array_except("tokens", F.array(*(F.lit(p) for p in sorted(PARTICLES))))) <= MAX_PARTS)
    asked = few.select("text", F.explode(F.array_distinct("tokens")).alias("token")).join(told, "token")
    return heads.select("text", "tokens").join(asked.groupBy("text").agg(F.collect_list("told").alias("told")), "text", "left")


def _tally(keyed: DataFrame) -> np.ndarray:
    """How many rows a block of each counter has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, n = np.unique((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(1)) % np.uint64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], ["slot", "n"])

    counted = keyed.select("key").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return table


def matching(left: list[str], right: list[str] | None, shapes: dict[str, tuple[str, tuple[str, ...]]], matcher: Matcher) -> Iterator[tuple[str, str]]:
    """The pairs of a large block that name the same: of two lists or, without a second, within one.

    Names of persons of two parts are compared by their distinct tokens: letters that two tokens can share bound their
    common subsequence, so that only few tokens are compared one by one, and pairs of names follow from pairs of tokens.
    """
    two = [x for x in (*left, *(right or ())) if shapes[x][0] == "person" and len(shapes[x][1]) == 2]
    place = {t: i for i, t in enumerate(dict.fromkeys(t for x in two for t in shapes[x][1]))}
    words = list(place)
    lengths = np.array([len(w) for w in words])
    profile = np.zeros((len(words), 32), dtype=np.uint8)
    for i, w in enumerate(words):
        np.add.at(profile[i], np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32) & 31, 1)
    told = np.array([bool(matcher.first.full(w)) or len(w) == 1 for w in words])
    surname, given = (np.zeros((len(words), len(words)), dtype=bool) for _ in range(2))
    for i, w in enumerate(words):
        shared = np.minimum(profile[i:], profile[i]).sum(axis=1, dtype=np.int64)
        near = (2 * shared >= min(SIMILAR, SIMILAR_FIRST) * (lengths[i:] + lengths[i])) | (shared >= np.minimum(lengths[i:], lengths[i]) - 3) | told[i:] | told[i]
        for j in (np.flatnonzero(near) + i).tolist():
            surname[i, j] = surname[j, i] = matcher._surnames(w, words[j])
            given[i, j] = given[j, i] = matcher.first_names(w, words[j])
    both = set(two)
    y = [x for x in (right if right is not None else left) if x in both]
    at = np.array([[place[t] for t in shapes[x][1]] for x in y], dtype=np.int64).reshape(-1, 2)
    for n, x in enumerate(x for x in left if x in both):
        f, l = (place[t] for t in shapes[x][1])
        hits = (surname[l, at[:, 1]] & given[f, at[:, 0]]) | (surname[f, at[:, 0]] & given[l, at[:, 1]]) | (surname[l, at[:, 0]] & given[f, at[:, 1]]) | (surname[f, at[:, 1]] & given[l, at[:, 0]])
        yield from ((x, y[j]) for j in np.flatnonzero(hits).tolist() if (right is not None or j > n) and matcher.same_shapes(shapes[x], shapes[y[j]]))
    for x, other in itertools.product(left, right) if right is not None else itertools.combinations(left, 2):
        if not (x in both and other in both) and matcher.same_shapes(shapes[x], shapes[other]):
            yield x, other


def links(names: DataFrame, common_share: float = COMMON_SHARE) -> DataFrame:
    """(a, b): pairs of texts, a < b, found in a common block and found to name the same."""
    spark = names.sparkSession
    heads = cut(heads_of(names))
    counts, total = _counts(heads)
    least = max(4, int(common_share * total))
    # A token that at least this share of names hold: there are at most (tokens of a name / share) of them.
    common = heads.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").count().where(F.col("count") >= least).select("t").toArrow()["t"].to_pylist()
    shared = spark.sparkContext.broadcast((counts, frozenset(common)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value
        matcher = Matcher(known)
        for batch in batches:
            keys = [block_keys(tuple(n), table, matcher.organisation(tuple(n)), FirstNames.of(t or ())) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys]))
            flat = np.array([k for row in keys for k in row], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(c.take(at) for c in batch.columns)], ["key", "text", "tokens", "told"])

    rows = cut(with_told(heads, learn_first_names(heads)).mapInArrow(keyed, "key bigint, text string, tokens array<string>, told array<string>"))
    tallied = spark.sparkContext.broadcast(_tally(rows))
    buckets = max(8, -(-total * 8 // BUCKET_NAMES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tallied.value
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            slices = table[((key >> np.uint64(1)) % np.uint64(COUNTERS)).astype(np.int64)] // SLICE_NAMES + 1
            mine = np.array([xxhash.xxh32_intdigest(t) for t in batch.column(1).to_pylist()], dtype=np.int64) % slices
            at = np.repeat(np.arange(batch.num_rows), slices)
            other = np.arange(len(at)) - np.repeat(np.cumsum(slices) - slices, slices)
            low, high = np.minimum(mine[at], other), np.maximum(mine[at], other)
            cell = low * (1 << 20) + high
            bucket = ((key[at] >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array((bucket % np.uint64(buckets)).astype(np.int32)), pa.array(cell), pa.array(mine[at] == high), *(c.take(take) for c in batch.columns)], ["bucket", "cell", "upper", "key", "text", "tokens", "told"])

    def compare(part: pa.Table) -> pa.Table:
        known = shared.value[1]
        first = FirstNames.of({t for told in part["told"].to_pylist() for t in told or ()})
        matcher, seen, found = Matcher(known, first), set(), []
        blocks: dict[tuple[int, int], list[tuple[str, tuple[str, ...], bool]]] = {}
        for key, cell, upper, text, name in zip(*(part[c].to_pylist() for c in ("key", "cell", "upper", "text", "tokens")), strict=True):
            blocks.setdefault((key, cell), []).append((text, tuple(name), upper))
        shapes = {text: matcher.shape(name) for block in blocks.values() if len(block) > 1 for text, name, _ in block}
        for (key, cell), block in blocks.items():
            across = cell >> 20 != cell & ((1 << 20) - 1)
            left = [text for text, _, upper in block if not (across and upper)]
            right = [text for text, _, upper in block if upper] if across else None
            if key & 1:
                # In blocks by initial or acronym only bare names are compared with others.
                lone = {text for text, name, _ in block if bare(name)}
                pairs = [(x, y) for x, y in (itertools.product(left, right) if across else itertools.combinations(left, 2)) if x in lone or y in lone] if lone else []
            elif len(block) <= SMALL_BLOCK:
                pairs = itertools.product(left, right) if across else itertools.combinations(left, 2)
            else:
                found += [(min(p), max(p)) for p in matching(left, right, shapes, matcher)]
                continue
            for pair in pairs:
                pair = (min(pair), max(pair))
                if pair not in seen:
                    seen.add(pair)
                    if matcher.same_shapes(shapes[pair[0]], shapes[pair[1]]):
                        found.append(pair)
        found = list(dict.fromkeys(found))
        return pa.table({"a": pa.array([p[0] for p in found], pa.string()), "b": pa.array([p[1] for p in found], pa.string())})

    cells = rows.mapInArrow(dealt, "bucket int, cell bigint, upper boolean, key bigint, text string, tokens array<string>, told array<string>")
    between = cells.groupBy("bucket").applyInArrow(compare, "a string, b string").distinct()
    # Texts of the same tokens are linked in a star; only one of each is compared with others.
    others = names.withColumn("name", F.array_join(F.array_sort("tokens"), " ")).select(F.col("text").alias("b"), "name")
    star = others.join(heads.select(F.col("text").alias("a"), "name"), "name").where(F.col("a") != F.col("b")).select("a", "b")
    return between.unionByName(star)


def components(edges: DataFrame) -> DataFrame:
    """(node, entity): connected components of ``edges`` (a, b); the entity is the smallest node of its component.

    Labels are taken from neighbours and then from the label's own label, so that chains close in logarithmic rounds;
    each round is cut.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("entity")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "entity"), "other").groupBy("node").agg(F.min("entity").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("entity").alias("was"), F.least("entity", "near").alias("entity"))
        jumped = stepped.join(labels.select(F.col("node").alias("entity"), F.col("entity").alias("far")), "entity", "left")
        after = cut(jumped.select("node", "was", F.coalesce(F.least("entity", "far"), "entity").alias("entity")))
        labels = after.select("node", "entity")
        if not after.where(F.col("was") != F.col("entity")).limit(1).count():
            return labels


def entities(traces: DataFrame, text: str, kind: str) -> DataFrame:
    """(text, entity): texts that name a person or organisation under more than one spelling, and their entity.

    A text with a bare initial joins the entity of the full names it fits if they are one entity; if they are several it
    stays with others of its kind, as it does if there is none. Rows with null or blank texts or other types are left
    out; repeated rows count once.
    """
    names = cut(names_of(traces, text, kind))
    found = cut(links(names))
    long = F.size(F.filter("tokens", lambda t: F.length(t) > 1))
    initial = names.where(F.get("tokens", F.lit(0)).startswith("=") | ((F.size("tokens") >= 2) & (long <= 1))).select("text")
    first = found.join(initial.select(F.col("text").alias("a"), F.lit(True).alias("ia")), "a", "left").join(initial.select(F.col("text").alias("b"), F.lit(True).alias("ib")), "b", "left")
    first = cut(first.select("a", "b", F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib")))
    full = components(first.where(~F.col("ia") & ~F.col("ib")).select("a", "b"))
    # Bare initials first form groups of their own, and a group joins an entity as a whole.
    short = components(first.where(F.col("ia") & F.col("ib")).select("a", "b"))
    mixed = first.where(F.col("ia") != F.col("ib")).select(F.when(F.col("ia"), F.col("a")).otherwise(F.col("b")).alias("short"), F.when(F.col("ia"), F.col("b")).otherwise(F.col("a")).alias("node"))
    mixed = mixed.join(full, "node", "left").select("short", F.coalesce("entity", "node").alias("entity"))
    mixed = mixed.join(short.select(F.col("node").alias("short"), F.col("entity").alias("group")), "short", "left").select("short", F.coalesce("group", "short").alias("group"), "entity")
    fits = cut(mixed.groupBy("group").agg(F.min("entity").alias("entity"), F.max("entity").alias("last")))
    one = fits.where(F.col("entity") == F.col("last")).select("group", "entity")
    grouped = short.select("node", F.col("entity").alias("group")).unionByName(mixed.select(F.col("short").alias("node"), "group")).distinct()
    placed = grouped.join(one, "group", "left").select("node", F.coalesce("entity", "group").alias("entity"))
    # An entity of one full name and its initials has no row in ``full``.
    heads = one.select("entity").distinct().join(full.select("entity").distinct(), "entity", "left_anti").select(F.col("entity").alias("node"), "entity")
    return full.unionByName(placed).unionByName(heads).withColumnRenamed("node", "text")


def same_entity_pairs(traces: DataFrame, text: str, kind: str) -> DataFrame:
    """(text_a, text_b): pairs of different texts of one entity, smaller first by code point."""
    found = entities(traces, text, kind)
    other = found.select("entity", F.col("text").alias("text_b"))
    return found.withColumnRenamed("text", "text_a").join(other, "entity").where(F.col("text_a") < F.col("text_b")).select("text_a", "text_b").distinct()
