import pytest

from lodespark.llm import mojibake as M

PROPER = [
    "naïve café — “Müller” cost €30 at 21 °C ± ½", "PÂTURAGES and CHÂTEAUX", "Μηδὲν ἄγαν", "Старый порт", "港口資料館", "😀🚀 and ❤️", "ﬁne ligatures", "İstanbul-like", "SÃO JOÃO", "zero​width no\xa0break",
    "FÄHRLEUTE, CASTAÑAS; CRUZÓ", "¿Quién? ¡Qué!", "L’œuvre d’été", "© 2020 ® ™ · 5 × 3", "plain ASCII?", "„Hof“ »x« ‚y‘", "m²",
]
SENTENCE = "Le château « naïf » fut détruit près de la forêt, où l’été s’étend — à 30 € ; Größe, Käse, señor, ¿Quién construyó la torre?"


@pytest.mark.parametrize("text", PROPER)
def test_proper_text_stays(text):
    assert M.restore(text) == (False, text)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman"])
def test_utf8_read_wrongly(wrong):
    chars = M._TABLES[wrong][0]
    garbled = "".join(chars[b] for b in SENTENCE.encode())
    hit, restored = M.restore(garbled)
    assert hit
    same = sum(a == b for a, b in zip(restored.split(" "), SENTENCE.split(" "), strict=False))
    assert same >= 0.85 * len(SENTENCE.split(" "))


def test_twice_and_in_part():
    twice = "Après la fête".encode().decode("cp1252").encode().decode("cp1252")
    assert M.restore(f"Clean été. {twice}") == (True, "Clean été. Après la fête")


def test_single_byte_mistakes():
    for wrong in ("cp1251", "cp437"):
        hit, restored = M.restore("Müller dirigió".encode("cp1252").decode(wrong))
        assert hit and restored == "Müller dirigió"


def test_lost_and_escaped():
    assert M.restore("caf�") == (True, "caf�")
    assert M.restore("caf&Atilde;&copy;") == (True, "café")


def test_tables(spark):
    rows = [(1, "cafÃ©"), (2, None), (3, ""), (4, "café"), (5, "x" * 100000 + " Ã©tÃ©"), (1, "cafÃ©"), (None, "prÃ¨s"), (6, "a�b")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, restored int, lossy boolean")
    got = [(r["doc_id"], r["restored"][-3:], r["lossy"]) for r in M.garbled(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, "afé", False), (1, "afé", False), (5, "été", False), (None, "rès", False), (6, "a�b", True)], key=str)
    assert M.garbled(df.limit(0), "doc_id", "text").count() == 0


def test_very_long_words_take_linear_time():
    assert M.restore("x" * 2_000_000) == (False, "x" * 2_000_000)
    hit, restored = M.restore("xÃ©" * 50_000)
    assert hit and restored == "xé" * 50_000
    assert M.restore("é" * 100_000 + "ñ" * 100_000)[0] is False


def test_marks_between_letters(spark):
    for garbled, proper in (("M„dchen", "Mädchen"), ("h”ren", "hören"), ("ma”tre", "maître"), ("r¡o", "río"), ("“M„dchen”", "“Mädchen”"), ("„Die M„dchen h”ren“", "„Die Mädchen hören“"), ("CR…ATION", "CRÉATION")):
        assert M.restore(garbled) == (True, proper)
    for text in ("wait…what", "the “big foo”bar", "said“the big one” again", "„Hof“und", "Hola¡Qué tal! dijo:¿Quién", "Hola¿Quién"):
        assert M.restore(text) == (False, text)
    df = spark.createDataFrame([(1, "Das M„dchen lief."), (2, "„Hof“und")], "doc_id long, text string")
    assert [tuple(r) for r in M.garbled(df, "doc_id", "text").collect()] == [(1, "Das Mädchen lief.", False)]


def test_orphan_lead_characters_are_found():
    for text in ("voilÃ est", "le chatâ€", "(voilÃ),"):
        assert M.restore(text) == (True, text)
    for text in ("JOÃ", "voilà"):
        assert M.restore(text) == (False, text)


# Proper words and paragraphs in languages that the corpus hardly holds.
WORDS = "Łódź Żółć gęślą jaźń Ağrı Čačak Škvorecký L·L COL·LEGI Şişli Žluťoučký İstanbul Győr Brașov Ţară Điện Þingvellir São Ærø Gabčíkovo Ştefan Hódmezővásárhely Đoković Łukasz Ľubica Ķekava Ħamrun ŵyn MĚŠŤAN NÍŽE MĘŻCZYZNA ŻÓŁĆ Óśmy Čeština".split()
SIGNS = "µm 5µg µmol Δx β-Carotin πr² 10Ω km² α φ(x)".split()
PARAGRAPHS = [
    "Zażółć gęślą jaźń. Wszystkie dzieci rodzą się wolne i równe pod względem swej godności i swych praw; ŁÓDŹ i ŻYWIEC leżą w Polsce.",
    "Příliš žluťoučký kůň úpěl ďábelské ódy. Všichni lidé rodí se svobodní; ČESKÁ TŘEBOVÁ a NÍŽE položené město, MĚŠŤAN.",
    "Pijamalı hasta yağız şoföre çabucak güvendi. Bütün insanlar hür doğarlar; İSTANBUL, ŞİŞLİ ve AĞRI Türkiye’dedir.",
    "Gojazni đačić s biciklom drži hmelj i finu vatu u džepu nošnje. Sva ljudska bića rađaju se slobodna; ŠIBENIK i ČAKOVEC.",
    "Árvíztűrő tükörfúrógép. Minden emberi lény szabadon születik; GYŐR és HÓDMEZŐVÁSÁRHELY magyar városok.",
    "Toate ființele umane se nasc libere și egale în demnitate; BRAȘOV și TÂRGU MUREȘ sunt orașe. Ţara şi oraşul.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng. ĐIỆN BIÊN PHỦ.",
    "Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa. ÞINGVELLIR.",
    "Le pianiste Antonín Dvořák est né près de Kralupy; Bohumil Hrabal, Josef Škvorecký et la ville de Łódź sont cités. Il a été joué à Győr.",
]


@pytest.mark.parametrize("text", [*WORDS, *SIGNS, *PARAGRAPHS])
def test_letters_of_all_latin_alphabets_stay(text):
    assert M.restore(text) == (False, text)


@pytest.mark.parametrize("text", PARAGRAPHS[:8])
@pytest.mark.parametrize("wrong", ["cp1252", "cp1250"])
def test_other_languages_are_restored(text, wrong):
    chars = M._TABLES[wrong][0]
    hit, restored = M.restore("".join(chars[b] for b in text.encode()))
    assert hit and sum(a == b for a, b in zip(restored.split(" "), text.split(" "), strict=False)) >= 0.85 * len(text.split(" "))


def test_the_document_decides_the_encodings():
    text = "Según la expedición, los fósiles de la montaña; JOÃO llegó."
    for wrong in ("cp1251", "cp437"):
        assert M.restore(text.encode("cp1252").decode(wrong)) == (True, text)
    french = "Le père a préféré la forêt à la crème, et le théâtre où il répète."
    assert M.restore(french.encode("cp1252").decode("cp1250")) == (True, french)


def test_search_without_bound_of_states():
    text = "é"
    for _ in range(6):
        text = "".join(M._TABLES["cp1252"][0][b] for b in text.encode())
    assert M.restore(f"caf{text}") == (True, "café")
