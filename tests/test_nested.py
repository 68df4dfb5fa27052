import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.operators import nested

RECORD = {
    "id": "r",
    "chunks": [{"id": "c0", "title": "A", "chunk": "x"}, None, {"title": "B", "chunk": None}, {"id": 7, "title": "A"}],
    "supporting_facts": [["A", 0], {"id": "c0"}, {"id": "gone", "title": "B"}, {"id": "gone"}, None, ["Z", 1]],
    "decomposition": {"id": 1, "question": "q", "supporting_facts": ["A", 2], "decomposition": json.dumps([{"question": "p"}, {"id": "s", "decomposition": {"id": "t"}}])},
}
EXPECTED = {
    ("chunk", "0", "c0"), ("chunk", "2", ""), ("chunk", "3", "7"),
    ("supporting_fact", "0", "7"), ("supporting_fact", "1", "c0"), ("supporting_fact", "2", ""), ("supporting_fact", "3", ""), ("supporting_fact", "5", ""),
    ("decomposition", "0", "1"), ("decomposition", "0.0", ""), ("decomposition", "0.1", "s"), ("decomposition", "0.1.0", "t"), ("supporting_fact", "0.0", "7"),
}


def found(spark, lines):
    df = spark.createDataFrame(lines, "line_no long, line string, kind string, path string, record string")
    parsed = nested.triples(df, "line_no", "line")
    return [tuple(r) for r in nested.link(parsed, "line_no").select("line_no", "kind", "path", "child_id").collect()]


def test_forms_of_nesting(spark):
    rows = found(spark, [(1, json.dumps(RECORD), "clash", "clash", "clash")])
    assert {r[1:] for r in rows} == EXPECTED and len(rows) == len(EXPECTED)


def test_maps_wrappers_and_text(spark):
    chunks = [{"id": "a", "title": "T"}, {"id": "b", "title": "U"}]
    shapes = [chunks, {"a": {"title": "T"}, "b": {"title": "U"}}, {"items": chunks, "count": 2}, json.dumps(chunks), {"items": json.dumps(chunks)}]
    rows = found(spark, [(i, json.dumps({"chunks": s, "supporting_facts": {"title": "U", "sent_id": 1}}), "", "", "") for i, s in enumerate(shapes)])
    for i in range(len(shapes)):
        assert {r[1:] for r in rows if r[0] == i} == {("chunk", "0", "a"), ("chunk", "1", "b"), ("supporting_fact", "0", "b")}


def test_broken_lines_give_nothing(spark):
    lines = [None, "", "  ", "{", "[1]", "3", '"x"', '{"chunks": ', '{"chunks": null}', '{"chunks": []} x', "{}"]
    assert found(spark, [(i, line, "", "", "") for i, line in enumerate(lines)]) == []


def test_null_and_repeated_keys(spark):
    line = json.dumps({"chunks": [{"id": "a"}]})
    rows = found(spark, [(None, line, "", "", ""), (None, json.dumps({"chunks": [{"id": "b"}]}), "", "", ""), (5, line, "", "", "")])
    assert sorted(rows, key=str) == sorted([(None, "chunk", "0", "a"), (None, "chunk", "0", "b"), (5, "chunk", "0", "a")], key=str)


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == []
    rows = found(spark, [(1, json.dumps({"chunks": [{"id": str(i), "chunk": "x" * 2000} for i in range(500)]}), "", "", "")])
    assert len(rows) == 500


def test_flat_table_keeps_parents(spark):
    df = spark.createDataFrame([(1, json.dumps(RECORD))], "line_no long, line string")
    steps = nested.pivot(nested.triples(df, "line_no", "line"), "line_no", "decomposition", (nested.KEY, "id", "question"))
    assert {(r["path"], r["parent"], r["question"]) for r in steps.collect()} == {("0", "", "q"), ("0.0", "0", "p"), ("0.1", "0", None), ("0.1.0", "0.1", None)}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda inner: st.lists(inner) | st.dictionaries(st.text(), inner), max_leaves=12), st.booleans(), st.sampled_from(["", " \n", "\t "]), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_parser_reads_what_json_reads(value, ascii_only, blanks, drop):
    def plain(held):
        if isinstance(held, nested.Object):
            return {k: plain(v) for k, v in held.items()}
        if isinstance(held, nested.Array):
            return [plain(v) for v in held]
        return json.loads(held) if isinstance(held, nested.Literal) else held

    text = blanks + json.dumps([value], ensure_ascii=ascii_only, indent=len(blanks) or None) + blanks
    assert plain(nested.read(text)) == [value]
    broken = text[: max(0, len(text) - drop)]
    try:
        want = json.loads(broken)
    except ValueError:
        want = None
    assert plain(nested.read(broken)) == (want if isinstance(want, list | dict) else None)


def test_parser_refuses_what_is_no_json():
    for text in ("[1,]", "{,}", '{"a":}', '{"a" 1}', "[1 2]", "[01]", '["\x01"]', "[1]]", '{"a":1]', "[} ", "{1:2}", '["\\x"]', "[1][2]"):
        assert nested.read(text) is None
    assert nested.read('{"a":1,"b":2,"a":[3.50]}') == {"a": ["3.50"], "b": "2"} and nested.parse_record('{"chunks":[{"id":1.50,"meta":{"a" :1}}]}')[1:] == [("chunk", 1, "id", "1.50", 0), ("chunk", 1, "meta", '{"a" :1}', 0)]


def test_depth_blanks_and_size(spark):
    depth, wide = 10_000, 100_000
    text = '{"decomposition":' + '[{"id":1,"decomposition":' * depth + "[]" + "}]" * depth + "}"
    blanks = " " * 1_000_000
    padded = json.dumps({"chunks": blanks + '[{"id": "a"}, {"id": "b"}]' + blanks})
    facts = json.dumps({"chunks": [{"id": str(i), "title": f"t{i % 1000}"} for i in range(wide)], "supporting_facts": [[f"t{i}", 0] for i in range(1000)] + [{"id": str(i)} for i in range(1000)]})
    rows = found(spark, [(1, text, "", "", ""), (2, padded, "", "", ""), (3, blanks + facts, "", "", "")])
    count = {n: sum(r[0] == n for r in rows) for n in (1, 2, 3)}
    assert count == {1: depth, 2: 2, 3: wide + 2000}
    assert max(len(r[2]) for r in rows if r[0] == 1) == 2 * depth - 1
    assert {r[3] for r in rows if r[0] == 3 and r[1] == "supporting_fact" and int(r[2]) < 1000} == {str(99_000 + i) for i in range(1000)}


def test_lines_of_one_key_and_unreadable_lines(spark):
    a, b = json.dumps({"chunks": [{"id": "a"}]}), json.dumps({"chunks": [{"id": "b"}]})
    assert sorted(found(spark, [(1, a, "", "", ""), (1, b, "", "", ""), (1, a, "", "", "")])) == [(1, "chunk", "0", "a"), (1, "chunk", "0", "b")]
    lines = [(1, a), (2, None), (3, " "), (4, "[1]"), (5, "3"), (6, "{"), (None, "x y")]
    df = spark.createDataFrame(lines, "line_no long, line string")
    got = {tuple(r) for r in nested.unreadable(df, "line_no", "line").collect()}
    assert got == {(2, "null"), (3, "blank"), (4, "no object"), (5, "no object"), (6, "no whole JSON"), (None, "no whole JSON")}


def test_halves_of_characters_do_not_break(spark):
    line = '{"chunks": [{"id": "a\\ud83d", "title": "\\ud83d\\ude00", "chunk": "\\u0000"}], "supporting_facts": [["\\ud83d\\ude00", 1]]}'
    assert {r[1:] for r in found(spark, [(1, line, "", "", "")])} == {("chunk", "0", "a\ufffd"), ("supporting_fact", "0", "a\ufffd")}
