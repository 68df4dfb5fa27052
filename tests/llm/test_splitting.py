import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.llm.splitting import Split, cuts, pieces

SMALL = Split(maximum=60, minimum=20, overlap=10, window=4, divisor=7)


def check(text, split):
    got = cuts(text, split)
    if not text:
        assert got == [(0, 0, 0, False)]
        return
    assert "".join(text[a:b] for a, _, b, _ in got) == text
    stretches = [len(m.group()) for m in re.finditer(r"[^ \t\r\n]+", text)]
    if len(text) > split.maximum:
        assert any(f for *_, f in got) == (max(stretches, default=0) > split.maximum)
    for i, (start, over, stop, forced) in enumerate(got):
        assert 0 < stop - start + over <= split.maximum and 0 <= over <= split.overlap and over <= start
        if i:
            before = text[got[i - 1][0] - got[i - 1][1] : got[i - 1][2]]
            assert before.endswith(text[start - over : start])
            if over and start - over > 0 and text[start - over : start] != before:
                assert text[start - over] in " \t\r\n" or text[start - over - 1] in " \t\r\n"
        if not forced and stop < len(text):
            assert text[stop - 1] in " \t\r\n" or text[stop] in " \t\r\n"


@given(st.text(alphabet="ab.  \n\r\té\U0001f600", max_size=500))
@settings(max_examples=150, deadline=None)
def test_pieces_of_any_text(text):
    check(text, SMALL)


@given(st.lists(st.sampled_from(["word", "x" * 59, "x" * 60, "x" * 61, "x" * 200, "End. ", "\n\n", " ", "     " * 20]), max_size=30))
@settings(max_examples=150, deadline=None)
def test_long_stretches(parts):
    check(" ".join(parts), SMALL)


def test_cuts_at_sentences():
    text = "This is a sentence of some length. " * 200
    for start, _, stop, forced in cuts(text, Split())[:-1]:
        assert not forced and text[start:stop].endswith(". ")


def test_overlap_is_what_was_asked():
    text = " ".join(f"w{i}" for i in range(3000))
    overlaps = [o for _, o, _, _ in cuts(text, Split())[1:]]
    assert min(overlaps) > 110 and max(overlaps) <= 128


def test_an_edit_moves_only_cuts_near_it():
    text = " ".join(f"word{i * 7919 % 1000}." for i in range(6000))
    edited = text[:3000] + "inserted " + text[3000:]
    before = {text[a:b] for a, _, b, _ in cuts(text, Split())}
    after = {edited[a:b] for a, _, b, _ in cuts(edited, Split())}
    assert len(after - before) <= 6 < len(after)


def test_tables(spark):
    rows = [("a", None), ("b", ""), ("c", "short"), ("d", "x" * 3000), ("e", "y " * 2000), ("e", "y " * 2000), (None, "z " * 2000), ("f", "x" * 2048 + " " + "y" * 100)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, body string, piece int, start int")
    got = pieces(df.select("id", "body"), ["id"], "body").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert "a" not in by and len(by["b"]) == len(by["c"]) == 1 and by["b"][0]["text"] == ""
    assert any(r["forced"] for r in by["d"]) and not any(r["forced"] for r in by["e"] + by["f"])
    assert sum(r["piece"] == 0 for r in by["e"]) == 2 and None in by
    assert max(len(r["text"]) for r in got) <= 2048
    assert {r["id"] for r in pieces(df, ["id"], "body", only_cut=True).collect()} == {"d", "e", "f", None}
    assert pieces(df.limit(0), ["id"], "body").count() == 0


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        pieces(spark.createDataFrame([("a", "b")], "id string, body string"), ["id"], "body", Split(maximum=10, minimum=9, overlap=5))
