import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.functions import metrics, models
from lodespark.functions import text as T
from lodespark.functions import vectors as V


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, T.normalize(F.col("t")), t="The Eiffel Tower is located in Paris, France.") == "eiffel tower located in paris france"
    assert one(spark, T.normalize(F.col("t")), t="  THE a-b  \n") == "ab"
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == ""


def test_answer_scores(spark):
    golds = ["The Eiffel Tower is in Paris.", "Paris, France is home to the Eiffel Tower."]
    p = "The Eiffel Tower is located in Paris, France."
    assert one(spark, metrics.token_f1(F.col("p"), F.col("g")), p=p, g=golds) == pytest.approx(0.8)
    assert one(spark, metrics.exact_match(F.col("p"), F.col("g")), p=p, g=golds) is False
    assert one(spark, metrics.exact_match(F.col("p"), F.col("g")), p="the", g=["a"]) is True
    assert one(spark, metrics.token_f1(F.col("p"), F.col("g")), p="the", g=["a"]) == 0
    assert one(spark, metrics.exact_match(F.lit(None).cast("string"), F.col("g")), g=["a"]) is False


def test_retrieval(spark):
    m = one(spark, metrics.retrieval_prf(F.col("r"), F.col("w"), 3), r=["d1", "d2", "d3", "d4"], w=["d1", "d3", "d5"])
    assert [round(x, 4) for x in m] == [0.6667] * 3
    assert tuple(one(spark, metrics.retrieval_prf(F.lit(None).cast("array<string>"), F.col("w")), w=["a"])) == (0, 0, 0)


def test_budget(spark):
    want = {0: 2, 1: 2, 2: 2, 3: 3, 4: 3, 5: 4, 15: 5, 30: 7, 60: 9, 110: 13, 120: 15, 200: 15}
    assert {k: one(spark, T.chunk_budget(F.col("k")), k=k) for k in want} == want


def test_types_and_importance(spark):
    for given, want in {"humanitarian event": "PERSON", "location": "LOC", "": "MISC", "datetime": "DATE", "ORG": "ORG", "nonsense": "MISC"}.items():
        assert one(spark, T.canonical_type(F.col("t")), t=given) == want
    for given, want in {"4": 4, "7": 5, "0": 1, "high": 5, "minor": 1, "": 3, "medium": 3, "99999999999": 5, "about 2 or 3": 2}.items():
        assert one(spark, T.canonical_importance(F.col("t")), t=given) == want
    assert one(spark, T.canonical_importance(F.lit(None).cast("string"))) == 3


def test_answers_and_previews(spark):
    assert one(spark, T.parse_answer(F.col("t")), t="r\nFINAL_ANSWER_TEXT: Paris") == "Paris"
    assert one(spark, T.parse_answer(F.col("t")), t="one\n two \n\n") == "two"
    assert one(spark, T.parse_answer(F.col("t")), t=" ") == ""
    assert one(spark, T.preview(F.col("t")), t="") == T.NO_PREVIEW
    assert one(spark, T.token_estimate(F.col("t")), t="0123456789") == 2
    assert one(spark, T.hop(F.col("t")), t="2hop__a_b") == 2 and one(spark, T.hop(F.col("t")), t="x2hop_") == 0


def test_salvage(spark):
    text = 'Here: [{"text": "A", "type": "", "importance_score": 9}, {"text": ""}, 3, "s", {"text": "B", "importance_score": "4.5", "description": "d"}] done'
    got = [tuple(e) for e in one(spark, T.salvage_json(F.col("t")), t=text)]
    assert got == [("A", "MISC", "", 3.0), ("B", "MISC", "d", 4.5)]
    for broken in ("no list", "[1, 2", "", "[{]"):
        assert one(spark, T.salvage_json(F.col("t")), t=broken) == []


def test_tolerant(spark):
    cases = {'["x", "y"]': ["x", "y"], '{"text": "a"} {"text": "b"}': ["a", "b"], 'say "q"': ["q"], "- one\n- two": ["one", "two"], "nothing": None, '```json\n[{"text": "z"}]\n```': ["z"]}
    for given, want in cases.items():
        assert one(spark, T.tolerant_entities(F.col("t")), t=given) == want


def test_file_stem(spark):
    assert tuple(one(spark, T.file_stem(F.col("t")), t="/a/run_top_k_5.json")) == ("run_top_k", "5")
    assert tuple(one(spark, T.file_stem(F.col("t")), t="plain.json")) == ("plain", "unknown")


def test_rouge():
    assert metrics.stem("caresses") == "caress" and metrics.stem("hopping") == "hop" and metrics.stem("relational") == "relat" and metrics.stem("sky") == "sky"
    assert metrics.rouge("the cat sat", "the cats sat") == (1.0, 1.0, 1.0)
    assert metrics.rouge("", "a") == (0.0, 0.0, 0.0)


def test_nearest_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[10] = data[20]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    corpus = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (10, 20, 7)], "query_id long, query_vector array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in V.nearest(asked, corpus, 12).collect()}
    for q in (10, 20, 7):
        d = ((data.astype(float) - data[q].astype(float)) ** 2).sum(axis=1).round(9)
        assert [got[q, r] for r in range(1, 13)] == np.lexsort((np.arange(300), d))[:12].tolist()
    assert V.nearest(asked, corpus.limit(0), 3).count() == 0 and V.nearest(asked.limit(0), corpus, 3).count() == 0
    assert V.nearest(asked, corpus, 1000).count() == 900


def test_query_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, [float(i), float(i % 3)]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = corpus.toDF("query_id", "query_vector")
    whole = sorted(V.nearest(asked, corpus, 4).collect())
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 10)
    assert sorted(V.nearest(asked, corpus, 4).collect()) == whole
    monkeypatch.setattr(V, "CELLS", 7)
    assert sorted(V.nearest(asked, corpus, 4).collect()) == whole
    assert V.nearest(asked, corpus.limit(0), 4).count() == 0


def test_cosine_of_nothing(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[2.0, 0.0], b=[1.0, 0.0]) == pytest.approx(1)


def test_embedding_and_completion(spark):
    df = spark.createDataFrame([("Alpha beta",), ("",), (None,), ("Alpha beta",)], "t string")
    got = models.embed_texts(df, "t", models.HashEmbedder(16)).collect()
    assert len(got) == 4 and all(len(r["embedding"]) == 16 for r in got)
    assert {round(sum(x * x for x in r["embedding"]), 4) for r in got if r["t"]} == {1.0}
    done = models.complete_prompts(df.limit(1).select(F.lit("1. Ann (Type: PERSON)").alias("p")), "p", models.EchoCompleter())
    assert done.first()["response"] == "FINAL_ANSWER_TEXT: Ann"
    assert models.with_retries(lambda: 1 / 0, attempts=2, delay=0, default="x") == "x"


def test_long_texts_are_read_whole(spark):
    filler = "word " * 1000
    assert [e["text"] for e in one(spark, models.extract_entities(F.col("t")), t=f"Anna Berg {filler}Late Entity")] == ["Anna Berg", "Late Entity"]
    df = spark.createDataFrame([(f"{filler}first",), (f"{filler}second",), ("x" * 5000,)], "t string")
    got = {r["t"][-6:]: r["embedding"] for r in models.embed_texts(df, "t", models.HashEmbedder(64)).collect()}
    assert got[" first"] != got["second"]
    assert all(sum(x * x for x in v) == pytest.approx(1, abs=1e-4) for v in got.values())
    assert "".join(models.embed_pieces(filler + "y" * 5000)) == filler + "y" * 5000 and max(map(len, models.embed_pieces(filler + "y" * 5000))) <= models.EMBED_CHARS


def test_status_filter_can_be_exact(spark):
    from lodespark.operators import retrieve

    corpus = spark.createDataFrame([(i, [float(i), 1.0], "active" if i >= 18 else "dormant") for i in range(20)], "vec_id long, embedding array<float>, status string")
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, query_vector array<float>")
    assert retrieve.with_status(asked, corpus, 2, ["active"]).count() == 0
    assert [(r["rank"], r["vec_id"]) for r in retrieve.with_status(asked, corpus, 2, ["active"], overfetch=None).orderBy("rank").collect()] == [(1, 18), (2, 19)]


def test_distances_held_at_once_are_bounded(monkeypatch):
    rng = np.random.default_rng(1)
    queries, rows = rng.normal(size=(50, 4)), rng.normal(size=(1000, 4))
    sizes = []
    monkeypatch.setattr(V, "CELLS", 500)
    best, real = V._Best(queries, 3), V._Best._add
    monkeypatch.setattr(V._Best, "_add", lambda self, ids, v: (sizes.append(len(ids) * len(self.queries)), real(self, ids, v))[1])
    best.add(np.arange(1000), rows)
    assert max(sizes) <= 500 and sum(sizes) == 50_000
    exact = ((queries[:, None] - rows[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :3]
    assert (best.ids == exact).all()


def test_hot_texts_are_joined_apart(spark):
    df = spark.createDataFrame([(i, "hot text" if i % 2 else f"word{i}") for i in range(400)] + [(900, None), (901, "")], "i long, t string")
    got = {r["i"]: r["embedding"] for r in models.embed_texts(df, "t", models.HashEmbedder(32)).collect()}
    want = models.HashEmbedder(32)
    assert len(got) == 402 and sum(got[900]) == 0 and sum(got[901]) == 0
    for i in range(400):
        assert got[i] == pytest.approx(want.embed(["hot text" if i % 2 else f"word{i}"])[0])


def test_cache_retries_and_tolerant_objects(spark):
    cached = models.CachedEmbedder(models.HashEmbedder(8), capacity=2)
    first = cached.embed(["a", "b", "a"])
    assert first[0] == first[2] and cached.embed(["b"]) == [first[1]] and cached.embed(["c", "a"])[1] == first[0]
    assert cached.stats() == {"size": 2, "capacity": 2, "hits": 3, "misses": 3, "hit_rate": 0.5}
    said = iter(["", "yes"])
    assert models.with_retries(lambda: next(said), attempts=2, delay=0, wanted=bool) == "yes"
    text = 'see [1] and [{"text": "A", "type": "ORG", "description": "d", "importance_score": 5}] or [x'
    assert [tuple(e) for e in one(spark, T.tolerant_objects(F.col("t")), t=text)] == [("A", "ORG", "d", 5.0)]
    assert [tuple(e) for e in one(spark, T.tolerant_objects(F.col("t")), t="- one")] == [("one", "MISC", "", 3.0)]
    assert one(spark, T.tolerant_objects(F.col("t")), t="nothing") is None
