import random

from pyspark.sql import functions as F

from lodespark.llm import leakage
from lodespark.llm.words import words


def tables(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, windows string")
    return d, spark.createDataFrame(items, "item_id long, question string, passage string")


def brute(docs, items, n):
    grams = {}
    for i, *texts in items:
        for t in texts:
            w = words(t)
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def case(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("alpha beta gamma Delta ÉTÉ 42 x_y".split()) + rng.choice(["", ",", ".", " -"]) for _ in range(n))
    items = [(i, text(rng.randint(3, 30)), text(rng.randint(5, 60))) for i in range(12)] + [(90, None, None), (91, "", "short"), (92, "shared " * 12, None), (93, None, "shared " * 15)]
    docs = [(i, text(rng.randint(0, 200))) for i in range(30)] + [(50, None), (51, ""), (52, "Shared, " * 13), (52, "Shared, " * 13), (None, "shared " * 12)]
    for i in range(10):
        docs.append((100 + i, text(30) + " " + (items[i][2] or "").upper() + " " + text(10)))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = case()
    d, t = tables(spark, docs, items)
    for n in (12, 5):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d.drop("item_id", "windows"), "doc_id", "text", t, "item_id", ["question", "passage"], n).collect()}
        assert got == brute(docs, items, n)
    monkeypatch.setattr(leakage, "MAX_ITEMS", 3)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, "doc_id", "text", t, "item_id", ["question", "passage"]).collect()}
    assert got == brute(docs, items, 12)


def test_shared_passages_are_all_reported(spark):
    docs, items = case()
    d, t = tables(spark, docs, items)
    got = {r["item_id"] for r in leakage.leaks(d, "doc_id", "text", t, "item_id", ["question", "passage"]).where("doc_id = 52").collect()}
    assert got == {92, 93}


def test_empty_tables(spark):
    d, t = tables(spark, [(1, "a " * 20)], [(1, "a " * 20, None)])
    for x, y in ((d.limit(0), t), (d, t.limit(0))):
        assert leakage.leaks(x, "doc_id", "text", y, "item_id", ["question", "passage"]).count() == 0


def test_spans_are_removed(spark):
    leak = " ".join(f"leak{i}" for i in range(15))
    d, t = tables(spark, [(1, f"Before it. {leak.upper()}! After İt. {leak}"), (2, "clean")], [(7, leak, None)])
    rows = leakage.remove_leaks(d.drop("item_id", "windows"), "doc_id", "text", t, "item_id", ["question", "passage"]).collect()
    assert [(r["doc_id"], r["spans"]) for r in rows] == [(1, 2)] and "leak3" not in rows[0]["clean"].lower() and "efore it. !" in rows[0]["clean"]


def test_join_gives_the_windows_of_the_scan(spark, monkeypatch):
    docs, items = case(5)
    d, t = tables(spark, docs, items)
    rows = lambda: sorted((str(r["doc_id"]), r["item_id"], tuple(r["windows"])) for r in leakage.leaks(d, "doc_id", "text", t, "item_id", ["question", "passage"]).collect())
    scanned = rows()
    monkeypatch.setattr(leakage, "MAX_CHARS", 10)
    # A full filter costs time only.
    for bits in (1 << 26, 1 << 10):
        monkeypatch.setattr(leakage, "MAX_BITS", bits)
        assert rows() == scanned
    assert leakage.leaks(d.limit(0), "doc_id", "text", t, "item_id", ["question", "passage"]).count() == 0


def test_a_million_items_take_one_scan(spark):
    word = lambda x, m: F.concat(F.lit("w"), F.pmod(F.xxhash64(x, F.lit(m)), F.lit(1_000_000)).cast("string"))
    text = F.concat_ws(" ", *[word("id", i) for i in range(13)])
    items = spark.range(0, 1_000_000, 1, 8).select(F.col("id").alias("item_id"), text.alias("question"), F.lit(None).cast("string").alias("passage"))
    docs = spark.range(0, 2_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("before all "), F.when(F.col("id") % 2 == 0, text).otherwise(F.lit("nothing of it")), F.lit(" and after")).alias("text"))
    found = leakage.leaks(docs, "doc_id", "text", items, "item_id", ["question", "passage"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 2000") == 1
    got = {(r["doc_id"], r["item_id"], tuple(r["windows"])) for r in found.collect()}
    assert got == {(i, i, (2, 3)) for i in range(0, 2_000, 2)}
