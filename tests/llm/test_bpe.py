import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.llm import bpe

PATH = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
TEXTS = [
    None, "", " ", "a", "hello world<|endoftext|> it's    x　　y\r\n\r\n  z'LL'll", "a" * 500 + "b" * 3000, "日本語テキスト😀👩‍👩‍👧‍👦", "ab" * 3000, "\x1c\x1d y \x85 z", "½²Ⅷ १२३ ٣",
    "ＡＢＣ ǅ é", " " * 3000 + "x", "don't DON'T we'll", "ﬁ​x\xa0y", "word " * 4000, "\n\n\n\t \n", "naïve café – “x”",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_equals_reference(spark, reference):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "null key"), (3, "again")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("k", F.lit(1))
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df, "doc_id", "text", PATH).collect()]
    want = [(i, reference(t)) for i, t in [*enumerate(TEXTS), (None, "null key"), (3, "again")]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_do_not_matter(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 3)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    assert {r[0]: r[1] for r in bpe.encode(df, "doc_id", "text", PATH).collect()} == {i: reference(t) for i, t in enumerate(TEXTS)}


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = bpe.encode(df, "doc_id", "text", PATH).select("doc_id", bpe.decode(F.col("ids"), PATH).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", PATH).count() == 0


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_heap_merges(text):
    import regex

    vocabulary = bpe.load(PATH)
    out = [i for w in regex.findall(bpe.PATTERN[4:], text) for i in bpe.merge_heap([vocabulary.byte_ids[b] for b in w.encode()], vocabulary)]
    assert b"".join(vocabulary.pieces[i] for i in out) == text.encode()
