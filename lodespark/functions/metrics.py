"""Answer and retrieval metrics as Column expressions; ROUGE as an Arrow UDF."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodespark.functions import text


def gold_answers(gold: Column, aliases: Column) -> Column:
    """The aliases with the gold answer appended if it is not among them; nulls left out."""
    held = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull())
    return F.when(gold.isNull() | F.array_contains(held, F.coalesce(gold, F.lit(""))), held).otherwise(F.array_append(held, gold))


def _once(values: list[Column], make: Callable[..., Column]) -> Column:
    """``make`` of values that are computed once, though it uses them within lambdas."""
    packed = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(packed, lambda e: make(*[e[f"v{i}"] for i in range(len(values))])), 0)


def exact_match(predicted: Column, golds: Column) -> Column:
    """Whether the prediction equals any gold answer once normalised; false for an empty prediction or without golds."""
    same = _once([text.normalize(predicted), golds], lambda told, given: F.exists(given, lambda g: text.normalize(g) == told))
    return F.coalesce((predicted != "") & (F.size(golds) > 0) & same, F.lit(False))


def bag_overlap(a: Column, b: Column) -> Column:
    """The size of the intersection of two arrays as bags: each element of one strikes its like from the other."""

    def strike(state: Column, word: Column) -> Column:
        at = F.array_position(state["left"], word).cast("int")
        rest = F.concat(F.slice(state["left"], F.lit(1), at - 1), F.slice(state["left"], at + 1, F.size(state["left"])))
        return F.when(at > 0, F.struct((state["n"] + 1).alias("n"), rest.alias("left"))).otherwise(state)

    return F.aggregate(a, F.struct(F.lit(0).alias("n"), b.alias("left")), strike, lambda s: s["n"])


def _f1(predicted: Column, gold: Column) -> Column:
    return _once([bag_overlap(predicted, gold).cast("double"), F.size(predicted) + F.size(gold)], lambda common, size: F.when(common > 0, 2 * common / size).otherwise(F.lit(0.0)))


def token_f1(predicted: Column, golds: Column) -> Column:
    """The best token F1 over gold answers that are not blank; 0 without any, or for a prediction without tokens."""

    def best(told: Column, given: Column) -> Column:
        return F.array_max(F.transform(given, lambda g: _f1(told, g)))

    wanted = F.transform(F.filter(golds, lambda g: ~text.blank(g)), text.tokens)
    return F.coalesce(_once([text.tokens(predicted), wanted], best), F.lit(0.0))


def retrieval_prf(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """Set precision, recall and F1; a cutoff applies before duplicates are dropped. Nulls count as empty."""
    empty = F.array().cast("array<string>")
    found = F.array_distinct(F.coalesce(retrieved if k is None else F.slice(retrieved, 1, k), empty))
    wanted = F.array_distinct(F.coalesce(relevant, empty))
    hits = F.size(F.array_intersect(found, wanted)).cast("double")
    p = F.when(F.size(found) > 0, hits / F.size(found)).otherwise(F.lit(0.0))
    r = F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(F.lit(0.0))
    f = F.when(hits > 0, 2 * hits / (F.size(found) + F.size(wanted))).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _measure(stem: str) -> int:
    shape = re.sub(r"(.)\1+", r"\1", "".join("v" if _VOWEL.match(stem, i) else "c" for i in range(len(stem))))
    return shape.count("vc")


#: Suffixes of the steps of Porter's stemmer (fixed values of the published algorithm): suffix, replacement, least measure.
_STEPS = (
    (("ational", "ate", 1), ("tional", "tion", 1), ("enci", "ence", 1), ("anci", "ance", 1), ("izer", "ize", 1), ("abli", "able", 1), ("alli", "al", 1), ("entli", "ent", 1), ("eli", "e", 1), ("ousli", "ous", 1), ("ization", "ize", 1), ("ation", "ate", 1), ("ator", "ate", 1), ("alism", "al", 1), ("iveness", "ive", 1), ("fulness", "ful", 1), ("ousness", "ous", 1), ("aliti", "al", 1), ("iviti", "ive", 1), ("biliti", "ble", 1)),
    (("icate", "ic", 1), ("ative", "", 1), ("alize", "al", 1), ("iciti", "ic", 1), ("ical", "ic", 1), ("ful", "", 1), ("ness", "", 1)),
    tuple((s, "", 2) for s in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()),
)


def stem(word: str) -> str:
    """Porter's stem of a small-letter word of more than three letters."""
    if len(word) <= 3:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and _VOWEL.search(word[: -len(s)])), None)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
            word = word[:-1]
        elif _measure(word) == 1 and re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", word):
            word += "e"
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for step in _STEPS:
        match = max((rule for rule in step if word.endswith(rule[0])), key=lambda rule: len(rule[0]), default=None)
        if match and _measure(word[: len(word) - len(match[0])]) >= match[2]:
            word = word[: len(word) - len(match[0])] + match[1]
        elif step is _STEPS[2] and match is None and re.search(r"[st]ion$", word) and _measure(word[:-3]) > 1:
            word = word[:-3]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def rouge(predicted: str, gold: str) -> tuple[float, float, float]:
    """ROUGE-1, -2 and -L F-measures on stemmed words of ASCII letters and digits."""
    a, b = ([stem(w) for w in re.sub(r"[^a-z0-9]+", " ", t.lower()).split()] for t in (predicted, gold))

    def f(hits: int, m: int, n: int) -> float:
        return 2 * hits / (m + n) if hits else 0.0

    def bag(n: int) -> float:
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        return f(sum((x & y).values()), sum(x.values()), sum(y.values()))

    row = [0] * (len(b) + 1)
    for w in a:
        last = 0
        for j, v in enumerate(b, 1):
            row[j], last = (last + 1 if w == v else max(row[j], row[j - 1])), row[j]
    return bag(1), bag(2), f(row[-1], len(a), len(b))


def rouge_scores(predicted: Column, golds: Column) -> Column:
    """The scores against the gold answer of the greatest ROUGE-L, the first among equals; 0 without gold answers."""

    @F.pandas_udf("rouge1 double, rouge2 double, rougeL double")
    def run(predicted: pd.Series, golds: pd.Series) -> pd.DataFrame:
        out = []
        for p, gs in zip(predicted, golds, strict=True):
            scores = [rouge(p or "", g) for g in (() if gs is None else gs) if g is not None and g.strip()]
            out.append(max(scores, key=lambda s: s[2], default=(0.0, 0.0, 0.0)))
        return pd.DataFrame(out, columns=["rouge1", "rouge2", "rougeL"])

    return run(predicted, golds)
