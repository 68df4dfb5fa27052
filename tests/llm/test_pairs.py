import random

import numpy as np
import pytest

from lodespark.llm import pairs as P

TOWNS = ["Essen", "Lyon", "Bilbao", "Leeds", "Bremen", "Nantes", "Toledo", "Derby"]
FIRST = ["Anna", "Carl", "Maria", "Paul", "Rosa", "Hugo", "Ines", "Otto"]
LAST = ["Bellmont", "Dornfeld", "Castellan", "Harrow", "Quarrel", "Tomlin", "Vasco", "Winter"]
FORMS = {
    "en": ("In which town was {n} born?", "{n} was born in the town of {t}."),
    "fr": ("Dans quelle ville est née {n} ?", "{n} est née dans la ville de {t}."),
    "de": ("In welcher Stadt wurde {n} geboren?", "{n} wurde in der Stadt {t} geboren."),
    "es": ("¿En qué ciudad nació {n}?", "{n} nació en la ciudad de {t}."),
}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(FORMS))
        name, town = f"{rng.choice(FIRST)} {rng.choice(LAST)}", rng.choice(TOWNS)
        q, a = FORMS[lang]
        out.append((q.format(n=name), rng.choice([a.format(n=name, t=town), town]), town))
    return out


@pytest.fixture(scope="module")
def model():
    return P.train(rows(600))


def test_held_out_accuracy(model):
    made = P._make(rows(300, seed=77), seed=8)
    right = sum(model.defect(q, a, r) == label for q, a, r, label in made)
    assert right / len(made) > 0.93


def test_kinds(model):
    q = "In which town was Rosa Harrow born?"
    for answer in (None, "", " \n", "​", "N/A", "null", "[]", "FINAL_ANSWER_TEXT: ", "—"):
        assert model.defect(q, answer, "Leeds") == "empty"
    assert model.defect(q, q, "Leeds") == "copied_question" and model.defect(q, q.lower().rstrip("?"), "Leeds") == "copied_question"
    assert model.defect(q, "I'm sorry, but I can't determine where that is.", "Leeds") == "refusal"
    assert model.defect(q, "Rosa Harrow est née dans la ville de Leeds.", "Leeds") == "other_language"
    assert model.defect(q, "Rosa Harrow was born in the", "Leeds") == "truncated"
    for fine in ("Leeds", "FINAL_ANSWER_TEXT: Leeds", "Rosa Harrow was born in the town of Leeds", "Derby"):
        assert model.defect(q, fine, "Leeds") is None


def test_tables(spark, model):
    data = [(1, "In which town was Rosa Harrow born?", None, "Leeds"), (2, None, "Leeds", None), (2, None, "Leeds", None), (None, "", "", ""), (3, "x" * 5000, "y" * 50000, "z")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "pid long, q string, a string, g string, field string, defect int")
    got = [tuple(r) for r in P.defects(df, "pid", "q", "a", "g", model).collect()]
    assert (1, "a", "empty") in got and got.count((2, "g", "empty")) == 2 and (None, "a", "empty") in got
    assert P.defects(df.limit(0), "pid", "q", "a", "g", model).count() == 0


def test_training_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows(50))], "pid long, q string, a string, g string")
    assert sorted(P.sample(df, "pid", "q", "a", "g")) == sorted(P.sample(df.repartition(7), "pid", "q", "a", "g"))
    first, second = P.train(rows(60)), P.train(rows(60))
    assert first.thresholds == second.thresholds


def test_training_on_nothing():
    assert P.train([]).defect("q", "an answer", None) in (None, *P.LABELS)


def test_refusals_of_unseen_wording():
    """Recall on refusals by rules that training did not see, over all rules in turn."""
    rng, hits, asked = np.random.default_rng(4), 0, 0
    questions = [q for q, *_ in rows(200, seed=5)]
    for held_out in ({0, 4}, {1, 5}, {2, 9}, {3, 10}):
        model = P.train(rows(800), held_out=frozenset(held_out))
        for q in questions[:100]:
            grammar = P.REFUSALS[P.language(q)]
            if told := [rule for i, rule in enumerate(grammar["rules"]) if i in held_out]:
                text = P.composed(rng, grammar, rule=told[int(rng.integers(len(told)))], n="Rosa Harrow")
                asked += 1
                hits += model.defect(q, text[:1].upper() + text[1:] + ".", None) == "refusal"
    assert hits >= 0.9 * asked > 200


def test_others_refusals_are_none(model):
    q = "In which town was Rosa Harrow born?"
    for answer in ("He could not attend the ceremony because of illness.", "Derby is no longer known as Otto but as Essen.", "The council refused to answer the judge in Leeds."):
        assert model.defect(q, answer, "Leeds") is None
    for answer in ("Can't say.", "No idea, honestly.", "Nothing in the text supports a reply."):
        assert model.defect(q, answer, None) == "refusal"


def test_all_labels_come_out(spark, model):
    df = spark.createDataFrame([(1, "In which town was Rosa Harrow born?", "Lo siento, no puedo responder a", "Leeds"), (2, "In which town was Rosa Harrow born?", "Leeds", "Leeds")], "pid long, q string, a string, g string")
    got = P.labelled(df, "pid", "q", "a", "g", model).collect()
    assert len(got) == 1 and got[0]["field"] == "a" and len(got[0]["labels"]) >= 1
    assert [r["defect"] for r in P.defects(df, "pid", "q", "a", "g", model).collect()] == [got[0]["labels"][0]]


def test_words_are_counted_over_all_rows(spark):
    data = rows(300)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "pid long, q string, a string, g string").repartition(5)
    want = P._lexicon(P._whole(data))
    got = P.count_words(df, "q", "a", "g")
    assert got.keys() == want.keys() and all(np.allclose(got[w], want[w]) for w in want)
    assert P.count_words(df.limit(0), "q", "a", "g") == {}
    made = P._make(data[:40])
    assert [f.hashed for f in P.described_in_tasks(spark)(made, want)] == [f.hashed for f in P._described(made, want)]
