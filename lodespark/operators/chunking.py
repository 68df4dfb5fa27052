"""Text splitters: the sliding character splitter and the recursive separator splitter, as Arrow UDFs."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.config import EngineConfig
from lodespark.functions import text as T

#: Separators of both splitters, in the order in which they are sought (fixed values).
SLIDING = (". ", "\n", " ")
RECURSIVE = ("\n\n", "\n", " ", "")


def sliding_spans(text: str, size: int, overlap: int, mode: str = "compat") -> list[tuple[int, int]]:
    """(start, end) of the sliding windows of ``text``.

    A window after the first that does not reach the end is shortened to the last separator in it. ``compat`` goes on
    after the window that reaches the end with every shorter suffix inside the overlap; ``clean`` stops there. The
    places of all separators are found once, so that the work grows with the text and not with its windows.
    """
    n = len(text)
    ends = [[m.end() for m in re.finditer(re.escape(s), text)] for s in SLIDING]

    def natural(start: int, reach: int) -> int:
        last = ((found[at - 1], len(s)) for s, found in zip(SLIDING, ends, strict=True) if (at := bisect_right(found, reach)))
        return next((end for end, width in last if end - width >= start), reach)

    spans = [(0, min(size, n))] if n else []
    while spans and spans[-1][1] < n:
        start = max(spans[-1][1] - overlap, spans[-1][0] + 1)
        spans.append((start, natural(start, start + size) if start + size < n else n))
    if spans and mode == "compat":
        spans += [(start, n) for start in range(max(n - overlap, spans[-1][0] + 1), n)]
    return spans


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            if joined := "".join(held).strip():
                out.append(joined)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if joined := "".join(held).strip():
        out.append(joined)
    return out


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = RECURSIVE) -> list[str]:
    """Pieces of at most ``size`` characters at the coarsest separators that serve, merged with ``overlap``."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        first, *rest = text.split(separator)
        parts = [p for p in (first, *(separator + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    small: list[str] = []
    for part in parts:
        if len(part) < size:
            small.append(part)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += recursive_split(part, size, overlap, finer) if finer else [part]
    return out + _merge(small, size, overlap)


def _udf(split: Callable[[str], list[tuple[int, str]]]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<start:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"start": s, "text": p} for s, p in split(t)])

    return run


def sliding(text: Column, config: EngineConfig) -> Column:
    size, overlap, mode = config.chunk_size, config.chunk_overlap, config.chunk_mode
    return _udf(lambda t: [(a, t[a:b]) for a, b in sliding_spans(t, size, overlap, mode)])(text)


def recursive(text: Column, config: EngineConfig) -> Column:
    """Texts within the size stay whole; starts are not known and 0."""
    size, overlap = config.chunk_size, config.chunk_overlap
    return _udf(lambda t: [(0, p) for p in (recursive_split(t, size, overlap) if len(t) > size else [t])])(text)


def chunks(docs: DataFrame, key: str, text: str, config: EngineConfig, splitter: str = "sliding", title: str | None = None) -> DataFrame:
    """(source_doc_id, chunk_idx, chunk_id, start, title, chunk_text): every document in chunks; blank chunks are dropped.

    Without chunking a document is one chunk. Null and blank texts give nothing; ids come from document and place. The
    title is null unless a column for it is named.
    """
    content = F.col(text)
    if not config.enable_chunking:
        split = F.array(F.struct(F.lit(0).alias("start"), content.alias("text")))
    else:
        split = (sliding if splitter == "sliding" else recursive)(content, config)
    named = (F.lit(None) if title is None else F.col(title)).cast("string").alias("title")
    rows = docs.where(~T.blank(content)).select(F.col(key).cast("string").alias("source_doc_id"), named, split.alias("pieces"))
    rows = rows.select("source_doc_id", "title", F.posexplode("pieces").alias("chunk_idx", "piece"))
    out = rows.select("source_doc_id", "chunk_idx", F.concat_ws("_chunk_", "source_doc_id", "chunk_idx").alias("chunk_id"), F.col("piece.start").alias("start"), "title", F.col("piece.text").alias("chunk_text"))
    return out.where(~T.blank(F.col("chunk_text")))
