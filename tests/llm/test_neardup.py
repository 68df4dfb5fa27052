import random

import pytest
from pyspark.sql import functions as F

from lodespark.llm import neardup
from lodespark.llm.words import words


def brute(rows, s=0.7):
    sets = [(i, frozenset(words(t))) for i, t in rows if i is not None and t is not None]
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and x and y and len(x & y) >= s * len(x | y) - 1e-9}


def corpus(n, seed, size=(1, 30), vocabulary=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(base) // 4))):
                act = rng.random()
                if act < 0.4 and base:
                    base.pop(rng.randrange(len(base)))
                elif act < 0.8:
                    base.insert(rng.randint(0, len(base)), f"w{rng.randrange(vocabulary)}")
                else:
                    rng.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(rng.randint(*size)))
        rows.append((f"id{i}", text))
    return rows


@pytest.mark.parametrize(("seed", "size", "slices"), [(1, (1, 30), 20000), (2, (1, 8), 5), (3, (150, 500), 20000)])
def test_equals_brute_force(spark, seed, size, slices, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_CELLS", 50)
    monkeypatch.setattr(neardup.class_links, "__defaults__", (0.7, slices))
    rows = corpus(160, seed, size)
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert got == brute(rows)


def test_other_similarity(spark):
    rows = corpus(120, 9)
    df = spark.createDataFrame(rows, "id string, text string")
    assert {tuple(r) for r in neardup.similar_pairs(df, 0.8).collect()} == brute(rows, 0.8)


def test_edge_cases(spark):
    rows = [("a", "x y z"), ("b", "z y x"), ("b", "z y x"), ("c", None), ("d", ""), ("e", "?!"), (None, "x y z"), ("f", "X, y_Z"), ("g", "q " * 5000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, text string, class string, words int")
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == {("a", "b"), ("a", "f"), ("b", "f")}
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_classes_count_links_not_copies(spark):
    rows = [(f"c{i}", "one two three four five six seven") for i in range(50)] + [("n", "one two three four five six seven eight"), ("x", "far off")]
    got = {r["id"]: r for r in neardup.similar_classes(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got["c0"]["copies"] == 50 and got["c0"]["links"] == 1 and got["n"]["links"] == 1 and got["x"]["links"] == 0
    assert len({got[f"c{i}"]["class"] for i in range(50)}) == 1


def test_nothing_is_broadcast_that_grows():
    assert neardup.COUNTERS <= 1 << 20 and neardup.FILTER <= 1 << 20 and F is not None
