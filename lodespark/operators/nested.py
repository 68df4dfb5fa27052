"""Deeply nested records as related flat tables.

Every record is read by a pull parser into path-value-ordinal triples. Paths that share a repeated ancestor (an element
of a list, of a keyed map, or a lone object standing for a list of one) form a group, and every group is pivoted into
one row of the table of its kind. Parents and children keep their links through the path of the holding element.

Parsing and walking keep stacks of their own, so that neither depth nor size of a record is limited by the interpreter.
A triple names the group by its number within the record; only one triple of a group, the one with an empty leaf, spells
the path out, as paths of deep elements are long.

Forms accepted for a repeated field, at any depth: a list, a lone object, a lone ``[title, sentence]`` pair, a map from
id to object, ``{"items": ...}`` with or without a count, and any of these once more encoded as JSON text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The repeated fields and the kind of their elements (fixed values of the record format).
KINDS = {"chunks": "chunk", "supporting_facts": "supporting_fact", "decomposition": "decomposition"}
#: Fields that an element of a repeated field has; an object with one of them is an element, not a map of elements.
ELEMENT_FIELDS = frozenset({"id", "title", "chunk", "sent_id", "question", "answer", "meta", "supporting_facts", "decomposition"})
#: The leaf that holds the key of an element given in a map.
KEY = "@key"
#: Triples that are handed to Spark at once.
BATCH = 50_000
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*)"|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))')
_BLANK = re.compile(r"[ \t\n\r]*")
_OPENS = re.compile(r"[ \t\n\r]*[{\[]")
_INTEGER = re.compile(r"-?\d+")
#: Half a character, which escapes can write and no text can hold; it is read as a replacement character.
_HALF = re.compile("[\ud800-\udfff]")

#: (kind, group, leaf, value, ordinal)
Triple = tuple[str, int, str, "str | None", int]


class Literal(str):
    """A number, true or false, as written."""


class Array(list):
    """A list and the text that it was read from."""

    source: tuple[str, int, int]


class Object(dict):
    """An object, of equal keys the last, and the text that it was read from."""

    source: tuple[str, int, int]


def events(text: str) -> Iterator[tuple[str, str | None, int]]:
    """(token, value, end) of a JSON text, pulled one by one: ``{}[],:``, ``s`` for strings, ``l`` for literals."""
    at, n = 0, len(text)
    while (m := _TOKEN.match(text, at)) is not None:
        mark, plain, quote, literal = m.groups()
        at = m.end()
        if mark is not None:
            yield mark, None, at
        elif plain is not None:
            yield "s", plain, at
        elif quote is not None:
            value, at = scanstring(text, at)
            yield "s", _HALF.sub("\ufffd", value), at
        else:
            yield "l", literal, at
    if _BLANK.match(text, at).end() != n:
        raise ValueError("no JSON")


def read(text: str) -> Array | Object | None:
    """The list or object that ``text`` is as a whole; None if it is anything else."""
    root: Array | Object | None = None
    stack: list[Array | Object] = []
    key: str | None = None
    # What may come next: a value (v), a value or the end of a list (V), a key (k), a key or the end of an object (K), a colon, or what follows a value (,).
    state = "v"
    try:
        for token, value, end in events(text):
            if token in "{[sl":
                if token == "s" and state in "kK":
                    key, state = value, ":"
                    continue
                if state not in "vV" or (not stack and (root is not None or token in "sl")):
                    return None
                held = Object() if token == "{" else Array() if token == "[" else value if token == "s" else None if value == "null" else Literal(value)
                if not stack:
                    root = held
                elif isinstance(stack[-1], Array):
                    stack[-1].append(held)
                else:
                    stack[-1][key] = held
                if token in "{[":
                    held.source = (text, end - 1, end)
                    stack.append(held)
                    state = "K" if token == "{" else "V"
                else:
                    state = ","
            elif token == ":":
                if state != ":":
                    return None
                state = "v"
            elif token == ",":
                if state != "," or not stack:
                    return None
                state = "v" if isinstance(stack[-1], Array) else "k"
            else:
                if not stack or state not in ("K," if token == "}" else "V,") or isinstance(stack[-1], Array) != (token == "]"):
                    return None
                closed = stack.pop()
                closed.source = (text, closed.source[1], end)
                state = ","
    except ValueError:
        return None
    return None if stack else root


def _decoded(value: object) -> object:
    """A list or object that stands as JSON text is read; anything else stays."""
    if type(value) is str and _OPENS.match(value):
        held = read(value)
        return value if held is None else held
    return value


def _elements(value: object) -> Iterator[tuple[int, object, str | None]]:
    """(place, element, key) of a repeated field; the key is given where the field is a map from id to element."""
    value = _decoded(value)
    while isinstance(value, Object) and not ELEMENT_FIELDS & value.keys() and "items" in value:
        value = _decoded(value["items"])
    if isinstance(value, Array):
        if len(value) == 2 and type(value[0]) is str and isinstance(value[1], Literal) and _INTEGER.fullmatch(value[1]) and _decoded(value[0]) is value[0]:
            yield 0, value, None
        else:
            for place, element in enumerate(value):
                yield place, _decoded(element), None
    elif isinstance(value, Object):
        if ELEMENT_FIELDS & value.keys():
            yield 0, value, None
        else:
            for place, (key, element) in enumerate(value.items()):
                yield place, _decoded(element), key


def _text(value: object) -> str | None:
    """The text of a leaf: strings as they are, all else as written."""
    if isinstance(value, Array | Object):
        text, start, end = value.source
        return text[start:end]
    return None if value is None else str(value)


def parse_record(line: str | None, keep: frozenset[str] | None = None) -> list[Triple] | None:
    """The triples of one record, of all leaves or of those in ``keep``; None for lines that are no whole JSON object."""
    record = read(line) if line is not None and _OPENS.match(line) else None
    if not isinstance(record, Object):
        return None
    out: list[Triple] = []
    group, work = 0, [(record, "")]
    while work:
        holder, prefix = work.pop()
        for field, kind in KINDS.items():
            if field not in holder or (field == "chunks" and prefix):
                continue
            for place, element, key in _elements(holder[field]):
                if isinstance(element, Array) and element and type(element[0]) is str:
                    element = {"title": element[0], "sent_id": element[1] if len(element) > 1 else None}
                if not isinstance(element, dict):
                    continue
                path = f"{prefix}.{place}" if prefix else str(place)
                group += 1
                out.append((kind, group, "", path, place))
                if key is not None and (keep is None or KEY in keep):
                    out.append((kind, group, KEY, key, place))
                for leaf, value in element.items():
                    if (keep is None or leaf in keep) and (kind != "decomposition" or leaf not in KINDS):
                        out.append((kind, group, leaf, _text(value), place))
                if kind == "decomposition":
                    work.append((element, path))
    return out


def _named(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(record, k, t) of the lines that are not null; ``record`` tells lines apart, those of one key too."""
    text = F.col(line)
    record = F.coalesce(F.concat(F.col(key).cast("string"), F.lit("#"), F.hex(F.xxhash64(text))), F.concat(F.lit("#"), F.sha1(text)))
    return lines.where(text.isNotNull()).select(record.alias("record"), F.col(key).cast("string").alias("k"), text.alias("t"))


def triples(lines: DataFrame, key: str, line: str, leaves: tuple[str, ...] | None = None) -> DataFrame:
    """(record, key, kind, group, leaf, value, ordinal) of every element of ``lines``.

    An element has at least one triple, with an empty leaf and its path. ``leaves`` keeps only the leaves named, so that
    long texts that no result needs are never shuffled. Lines that are null, blank, not whole JSON or no object give
    nothing (``unreadable`` lists them). Different lines under one key are different records; a line repeated under its
    key is the same record, and null keys are told apart by a digest of the line.
    """
    keep = None if leaves is None else frozenset(leaves)
    shape = pa.schema([("record", pa.string()), (key, pa.string()), ("kind", pa.string()), ("group", pa.int32()), ("leaf", pa.string()), ("value", pa.string()), ("ordinal", pa.int32())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for record, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(record, number, *t) for t in parse_record(text, keep) or ()]
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    parsed = _named(lines, key, line).mapInArrow(parse, f"record string, `{key}` string, kind string, group int, leaf string, value string, ordinal int")
    return parsed.withColumn(key, F.col(key).cast(lines.schema[key].dataType))


def unreadable(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, reason) of the lines without triples of their own: 'null', 'blank', 'no whole JSON' or 'no object'."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or not text.strip():
                    rows.append((number, "null" if text is None else "blank"))
                elif not isinstance(held := read(text), Object):
                    # A scalar is read as the only element of a list.
                    rows.append((number, "no object" if held is not None or read(f"[{text}]") is not None and len(read(f"[{text}]")) == 1 else "no whole JSON"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["k", "reason"])

    judged = lines.select(F.col(key).cast("string").alias("k"), F.col(line).alias("t")).mapInArrow(judge, "k string, reason string")
    return judged.select(F.col("k").cast(lines.schema[key].dataType).alias(key), "reason")


def pivot(parsed: DataFrame, key: str, kind: str | None, leaves: tuple[str, ...]) -> DataFrame:
    """One row per element: (record, key, kind, path, parent, ordinal, one column per leaf).

    All triples of an element come from one record, so a group never exceeds the record.
    """
    rows = parsed if kind is None else parsed.where(F.col("kind") == kind)
    picked = [F.max(F.when(F.col("leaf") == leaf, F.col("value"))).alias(leaf) for leaf in leaves]
    once = [F.first(c).alias(c) for c in (key, "kind", "ordinal")]
    path = F.max(F.when(F.col("leaf") == "", F.col("value"))).alias("path")
    grouped = rows.groupBy("record", "group").agg(path, *once, *picked)
    held = F.length("path") - F.length(F.col("ordinal").cast("string"))
    return grouped.select("record", key, "kind", "path", F.substring(F.col("path"), F.lit(1), F.greatest(held - 1, F.lit(0))).alias("parent"), "ordinal", *leaves)


def own_id() -> Column:
    """The id given as a field, else as the key of a map; '' without any."""
    return F.coalesce(F.when(F.col("id") != "", F.col("id")), F.col(KEY), F.lit(""))


def link(parsed: DataFrame, key: str) -> DataFrame:
    """(record, key, kind, path, parent, child_id) of every element, supporting facts resolved to a chunk.

    A fact stands for the chunk of its record with its id, else for the last chunk with its title ('' if that has no
    id), else ''. One exchange by record serves the pivot and both look-ups, which gather one value per id and per title
    of a record.
    """
    rows = pivot(parsed.repartition("record"), key, None, (KEY, "id", "title"))
    rows = rows.select("record", key, "kind", "path", "parent", "ordinal", "title", own_id().alias("own"))
    chunk = F.col("kind") == "chunk"
    with_id = F.max(chunk & (F.col("own") != "")).over(Window.partitionBy("record", "own"))
    with_title = F.max(F.when(chunk & F.col("title").isNotNull(), F.struct("ordinal", "own"))).over(Window.partitionBy("record", "title"))["own"]
    rows = rows.withColumn("with_title", with_title).withColumn("with_id", with_id)
    fact = F.when(F.col("with_id"), F.col("own")).otherwise(F.coalesce("with_title", F.lit("")))
    child = F.when(F.col("kind") == "supporting_fact", fact).otherwise(F.col("own"))
    return rows.select("record", key, "kind", "path", "parent", child.alias("child_id"))
