import itertools
import random

from lodespark.llm import names as N

GROUPS = [
    ["Josephine Fisteremiboth", "Josie Fisteremiboth", "J. Fisteremiboth", "J Fisteremiboth", "Fisteremiboth, Josephine", "Prof. Josephine Fisteremiboth", "JOSEPHINE FISTEREMIBOTH", "Josephine  Fisteremiboth", "Josephine K. Fisteremiboth", "Josephine Fsiteremiboth", "Josephine Fisteremibóth", "Fisteremiboth Josephine"],
    ["Oliver Fisteremiboth", "Ollie Fisteremiboth", "O. Fisteremiboth"],
    ["Sizelaforul University of Optics", "Sizelaforul Univ. of Optics", "University of Optics, Sizelaforul", "Uni of Optics (Sizelaforul)", "The Sizelaforul University of Optics", "Sizelaforul University of Optics, Inc.", "Sizelaforul-University of Optics", "Sizelaforul University of Otics"],
    ["Sizelaforul International Geology Council", "Sizelaforul Int'l Geology Council", "Intl. Geology Council (Sizelaforul)"],
    ["Sizelaforul Society for Botany and Crafts", "Sizelaforul Soc. for Botany & Crafts"],
    ["Robert Mokrinozehund", "Bob Mokrinozehund"],
]
LONE = ["y" * 50_000 + " Long", "word " * 3000, "Harold Favabijula", "Sizelaforul Museum of Optics", "river trade", "x", "12 May 1986"]


def traces(spark, extra=()):
    rows = [(t, k) for group in GROUPS for t in group for k in ("Person", "org ")] + [(t, "HUMAN") for t in LONE]
    rows += [("Oliver Fisteremiboth", "LOC"), ("Robert Mokrinozehumd", "LOC"), (None, "PERSON"), ("", "PERSON"), ("  ", "ORG"), ("Nobody Here", None), *extra]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "entity_text string, entity_type string, text int, entity int")


def test_variants_are_linked(spark):
    got = {tuple(r) for r in N.same_entity_pairs(traces(spark), "entity_text", "entity_type").collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got == want


def test_ambiguous_initial_stays_alone(spark):
    extra = [("Olaf Fisteremiboth", "PERSON")]
    got = {tuple(r) for r in N.same_entity_pairs(traces(spark, extra), "entity_text", "entity_type").collect()}
    assert not any("O. Fisteremiboth" in p for p in got)


def test_common_suffixes_are_refined(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NAMES", 0)
    got = {tuple(r) for r in N.same_entity_pairs(traces(spark), "entity_text", "entity_type").collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_empty(spark):
    assert N.same_entity_pairs(traces(spark).limit(0), "entity_text", "entity_type").count() == 0


def test_lcs():
    assert N.lcs("hydrology", "horology") == 7 and N.lcs("", "a") == 0 and N.lcs("abc", "abc") == 3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["entity"] for r in N.components(edges).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 43


def test_pairs_of_a_common_surname_meet(spark):
    # 150 Smiths and 150 Lees: more than a block of a suffix may hold.
    others = [f"{a}{b}x{c} {s}" for s in ("Smith", "Lee") for a, b, c in itertools.islice(itertools.product("VWXYZ", "aeiou", "cdfgkm"), 150)]
    extra = [(t, "PERSON") for t in [*others, "Robert Smith", "Bob Smith", "R. Smith", "Robert Lee", "Bob Lee", "R. Lee", "Lee, Robbie"]]
    got = {tuple(r) for r in N.same_entity_pairs(traces(spark, extra), "entity_text", "entity_type").collect()}
    for group in (["Robert Smith", "Bob Smith", "R. Smith"], ["Robert Lee", "Bob Lee", "R. Lee", "Lee, Robbie"]):
        assert {tuple(sorted(p)) for p in itertools.combinations(group, 2)} <= got


def test_short_surnames():
    same = N.Matcher(frozenset()).same
    assert same(("bob", "lee"), ("robert", "lee")) and same(("r", "lee"), ("lee", "robert"))
    assert not same(("bob", "lee"), ("bob", "leo")) and not same(("bob", "lee"), ("robert", "low")) and not same(("bob", "f"), ("bob", "favabijula"))


def test_relatives_stay_apart():
    same = N.Matcher(frozenset()).same
    for a, b in (("robert", "roberta"), ("maria", "mario"), ("daniel", "danielle"), ("paul", "paula"), ("joseph", "josephine"), ("julius", "julia"), ("mary", "john"), ("ann", "peter")):
        assert not same((a, "smithson"), (b, "smithson")) and not same((b, "smithson"), (a, "smithson"))


def test_forms_of_first_names():
    same = N.Matcher(frozenset()).same
    for a, b in (("steve", "stephen"), ("gerry", "gerald"), ("babs", "barbara"), ("ben", "benjamin"), ("xander", "alexander"), ("lizzie", "elizabeth"), ("eddie", "edward"), ("nick", "nicholas"), ("becky", "rebecca"), ("jo", "josephine"), ("isabeella", "isabella"), ("rob", "robert"), ("bob", "rob")):
        assert same((a, "smithson"), (b, "smithson")), (a, b)


def test_longer_names_and_acronyms():
    same, t = N.Matcher(frozenset()).same, N.tokens
    for a, b in (
        ("Robert James Smithson", "Robert J. Smithson"), ("J. R. Smithson", "John R. Smithson"), ("Ludwig van Beethoven", "L. van Beethoven"), ("Robert Smithson", "Robert James Smithson"), ("Smithson, Robert James", "Bob J. Smithson"),
        ("International Business Machines", "IBM"), ("International Business Machines Corp.", "I.B.M.C."), ("Ludwig van Beethoven", "Beethoven, Ludwig van"),
    ):
        assert same(t(a), t(b)) and same(t(b), t(a)), (a, b)
    for a, b in (("Robert James Smithson", "Robert Henry Smithson"), ("Robert Smithson Park", "Robert Smithson"), ("J. R. Smithson", "Mary R. Smithson"), ("International Business Machines", "INC"), ("Smithson Park", "Robert Smithson")):
        assert not same(t(a), t(b)), (a, b)


def test_an_acronym_of_two_organisations_stays_alone(spark):
    rows = [("International Business Machines", "ORG"), ("IBM", "ORG"), ("World Food Fund", "ORG"), ("Winter Fruit Fair", "ORG"), ("WFF", "ORG"), ("Robert James Smithson", "PERSON"), ("Robert J. Smithson", "PERSON")]
    df = spark.createDataFrame(rows, "entity_text string, entity_type string")
    assert {tuple(r) for r in N.same_entity_pairs(df, "entity_text", "entity_type").collect()} == {("IBM", "International Business Machines"), ("Robert J. Smithson", "Robert James Smithson")}


def invented(n, vowels, consonants, syllables):
    """``n`` pronounceable words, none a part of another."""
    parts = [c + v for c in consonants for v in vowels]
    return ["".join(parts[(i * (7 + 3 * k) + i // len(parts) + k) % len(parts)] for k in range(syllables)) + consonants[i % len(consonants)] for i in range(n)]


def test_unlisted_forms_are_learned(spark):
    # First names with a form that shares no letters with them; no list or rule can know these.
    first = dict(zip(invented(12, "aeiou", "bdgklm", 3), invented(12, "y", "prstvz", 2), strict=True))
    surnames = sorted(set(invented(240, "aeiou", "bdfgklmnprstvz", 5)))
    rows, want = [], set()
    for i, s in enumerate(surnames):
        full, form = list(first.items())[i % 12]
        rows.append((f"{full.title()} {s.title()}", "PERSON"))
        if i % 3 == 0:
            rows.append((f"{form.title()} {s.title()}", "PERSON"))
            want.add(tuple(sorted((rows[-1][0], rows[-2][0]))))
        if i % 7 == 0:
            # A relative.
            rows.append((f"{list(first)[(i + 5) % 12].title()} {s.title()}", "PERSON"))
    got = {tuple(r) for r in N.same_entity_pairs(spark.createDataFrame(rows, "entity_text string, entity_type string"), "entity_text", "entity_type").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def strangers(n):
    """``n`` names of which no two have a token in common or a similar one."""
    rng = random.Random(11)
    return list(dict.fromkeys(f"{''.join(rng.choices('bcdfghklmnprstvwz', k=9)).title()} {''.join(rng.choices('abcdefghijklmnoprstuvwyz', k=14)).title()}" for _ in range(n)))


def test_unlisted_forms_are_learned_in_tables_of_any_size(spark):
    # A form found with two rare surnames, and one full name that three have.
    rows = ["Kemidal Bandrelik", "Wuxo Bandrelik", "Kemidal Tosminarg", "Wuxo Tosminarg", "Kemidal Furgolant"]
    want = {("Kemidal Bandrelik", "Wuxo Bandrelik"), ("Kemidal Tosminarg", "Wuxo Tosminarg")}
    for n in (40, 41_000):
        df = spark.createDataFrame([(t, "PERSON") for t in rows + strangers(n)], "entity_text string, entity_type string").repartition(8)
        assert want == {tuple(r) for r in N.same_entity_pairs(df, "entity_text", "entity_type").where("text_b like 'Wuxo %' or text_a like 'Wuxo %' or text_a like 'Kemidal %'").collect()}, n


def test_what_is_told_of_first_names_does_not_depend_on_the_size(spark):
    # Two forms of one name, by two surnames each, and a name of its own with five surnames.
    rows = [["kemidal", s] for s in ("bandrelik", "tosminarg", "furgolant", "hispodern", "quilmatov")] + [["wuxo", "bandrelik"], ["wuxo", "tosminarg"], ["zofy", "furgolant"], ["zofy", "hispodern"]]
    rows += [["otrivel", f"{a}lsomp"] for a in "bdfgk"]
    seen = spark.createDataFrame([(" ".join(t), t) for t in rows], "text string, tokens array<string>")
    for n in (60, 101_000):
        others = spark.range(n).selectExpr("concat('x', id, ' ', 'y', id) text", "array(concat('x', id), concat('y', id)) tokens")
        got = {r["token"]: r["told"] for r in N.learn_first_names(seen.unionByName(others)).collect()}
        assert got == {"wuxo": "wuxo kemidal", "zofy": "zofy kemidal", "otrivel": "otrivel"}, n


def test_what_is_told_goes_with_the_names(spark):
    names = [["bo", "smith"], ["anna", "van", "der", "bo"], ["y", "k"], ["world", "food", "and", "bo", "fruit", "fund", "fair"]]
    heads = spark.createDataFrame([(" ".join(t), t) for t in names], "text string, tokens array<string>")
    told = spark.createDataFrame([("bo", "bo robert albert"), ("anna", "anna")], "token string, told string")
    got = {r["text"]: r["told"] and sorted(r["told"]) for r in N.with_told(heads, told).collect()}
    assert got == {"bo smith": ["bo robert albert"], "anna van der bo": ["anna", "bo robert albert"], "y k": None, "world food and bo fruit fund fair": None}
    assert N.FirstNames.of(["bo robert albert", "anna"]) == N.FirstNames({"bo": frozenset({"robert", "albert"})}, frozenset({"anna"}))


def test_common_tokens_cost_little(spark):
    """Recall of the share from which tokens count as common, against no common tokens at all."""
    names = N.cut(N.names_of(traces(spark, [(f"{f} Fisteremiboth", "PERSON") for f in ("Anna", "Karl", "Peter", "Hugo", "Nora")]), "entity_text", "entity_type"))
    with_common = {tuple(r) for r in N.links(names).collect()}
    without = {tuple(r) for r in N.links(names, common_share=1.0).collect()}
    assert len(with_common & without) >= 0.95 * len(without)


def test_a_block_of_ten_thousand_names_is_split(spark):
    # One surname and first names of the same three letters: every pair shares a refined block.
    rng = random.Random(3)
    firsts = sorted({"rob" + "".join(rng.choices("cdfghijklmnpqstuvwxyz", k=8)) for _ in range(10_000)})
    rows = [(f"{f} Quendrith", "PERSON") for f in firsts] + [("Robert Quendrith", "PERSON"), ("Bob Quendrith", "PERSON"), ("Roberrt Quendrith", "PERSON")]
    df = spark.createDataFrame(rows, "entity_text string, entity_type string").repartition(8)
    got = {tuple(r) for r in N.links(N.names_of(df, "entity_text", "entity_type")).where("b = 'Robert Quendrith' or (a = 'Roberrt Quendrith' and b = 'Robert Quendrith')").collect()}
    assert {("Bob Quendrith", "Robert Quendrith"), ("Roberrt Quendrith", "Robert Quendrith")} <= got


def test_large_blocks_give_what_pairs_give():
    matcher = N.Matcher(frozenset({"smith", "anna"}), N.FirstNames({"zed": frozenset({"anna"})}, frozenset()))
    rng = random.Random(5)
    texts = [f"{rng.choice(['Anna', 'Annie', 'Zed', 'A.', 'Bob', 'Robert', 'Roberta', 'Hanna'])} {rng.choice(['Smith', 'Smyth', 'Smithe', 'Schmidt'])}" for _ in range(60)] + ["Smith Anna", "Smith, Robert", "Robert J. Smith", "Smith University of Optics"]
    texts = list(dict.fromkeys(texts))
    shapes = {t: matcher.shape(N.tokens(t)) for t in texts}
    want = {p for p in itertools.combinations(texts, 2) if matcher.same_shapes(shapes[p[0]], shapes[p[1]])}
    assert set(N.matching(texts, None, shapes, matcher)) == want and want
    half = len(texts) // 2
    assert set(N.matching(texts[:half], texts[half:], shapes, matcher)) == {p for p in want if (p[0] in texts[:half]) != (p[1] in texts[:half])}
