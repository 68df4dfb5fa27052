"""Splitting oversized items at natural boundaries.

Content-defined chunking: a rolling hash over a short window of characters marks landmarks that depend on the content
alone. A cut is made at the natural boundary (paragraph, sentence, word) nearest to the first landmark between the
minimum and the maximum size, so that an edit moves only the cuts near it. Where a stretch without white space leaves
no boundary the cut is forced. Each piece begins with the end of the piece before it, whole words only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE_CODES = np.array([32, 9, 13, 10], dtype=np.uint32)
_PARAGRAPH = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t\r\n]*)")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*[ \t\r\n]+|\r?\n[ \t\r\n]*")
PIECES = "piece int, start int, overlap int, stop int, forced boolean, text string"


@dataclass(frozen=True)
class Split:
    """Sizes in code points. ``window`` and ``divisor`` belong to the rolling hash: one landmark in ``divisor`` places."""

    maximum: int = 2048
    minimum: int = 1024
    overlap: int = 128
    window: int = 24
    divisor: int = 192


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def landmarks(text: str, split: Split) -> np.ndarray:
    """The places after which the rolling hash of the last ``window`` characters is a multiple of ``divisor``."""
    codes = _codes(text).astype(np.uint64)
    if len(codes) < split.window:
        return np.empty(0, dtype=np.int64)
    rolled = np.zeros(len(codes) - split.window + 1, dtype=np.uint64)
    for i in range(split.window):
        rolled = rolled * np.uint64(0x9E3779B1) + codes[i : i + len(rolled)]
    rolled ^= rolled >> np.uint64(29)
    return np.flatnonzero(rolled % np.uint64(split.divisor) == 0) + split.window


def _between(places: np.ndarray, low: int, high: int) -> np.ndarray:
    return places[np.searchsorted(places, low) : np.searchsorted(places, high, "right")]


def cuts(text: str, split: Split) -> list[tuple[int, int, int, bool]]:
    """(start, overlap, stop, forced) of the pieces: piece = text[start - overlap : stop]; ``forced`` tells of its end.

    The texts [start, stop) partition ``text``. A forced cut lies inside a stretch longer than ``maximum`` only.
    """
    n, size = len(text), split.maximum
    if n <= size:
        return [(0, 0, n, False)]
    marks = landmarks(text, split)
    blank = np.isin(_codes(text), _SPACE_CODES)
    ends = np.flatnonzero(blank[1:] | blank[:-1]) + 1
    levels = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in (_PARAGRAPH, _SENTENCE)] + [ends]
    out: list[tuple[int, int, int, bool]] = []
    start = begin = 0
    while True:
        # The last characters of the piece before; fewer where that would begin within a word.
        heads = _between(ends, max(start - split.overlap, begin), start - 1) if start else ends[:0]
        overlap = start - begin if start and start - begin <= split.overlap else start - int(heads[0]) if len(heads) else 0
        if n - start + overlap <= size:
            return [*out, (start, overlap, n, False)]
        high = start + size - overlap
        mark = _between(marks, start + split.minimum, high)
        aim = int(mark[0]) if len(mark) else high
        stop = 0
        for reach, level in zip((size // 4, size // 4, size), levels, strict=True):
            near = _between(level, max(start + split.minimum, aim - reach), min(high, aim + reach))
            if len(near):
                stop = int(near[np.abs(near - aim).argmin()])
                break
        if not stop:
            # No boundary beyond the minimum: the last one before it or, without overlap, any in reach.
            near = _between(ends, start + 1, high)
            if not len(near):
                overlap, high = 0, start + size
                near = _between(ends, start + 1, min(high, n - 1))
            if not len(near) and n - start <= size:
                return [*out, (start, 0, n, False)]
            stop = int(near[-1]) if len(near) else 0
        forced = not stop
        stop = stop or (aim if start < aim <= high else high)
        out.append((start, overlap, stop, forced))
        begin, start = start - overlap, stop


def pieces(items: DataFrame, keys: list[str], text: str, split: Split = Split(), only_cut: bool = False) -> DataFrame:
    """(keys, piece, start, overlap, stop, forced, text): every item in pieces of at most ``maximum`` code points.

    ``forced`` tells that the piece ends inside a stretch without white space. Items within the limit come out as one
    piece as they are (empty texts too), without leaving the JVM; null texts have no piece. ``only_cut`` leaves the
    uncut out. Repeated rows are cut each; key columns may have any names and types.
    """
    if not 0 <= split.overlap < split.minimum < split.maximum - split.overlap:
        raise ValueError("need overlap < minimum < maximum - overlap")
    shape = ", ".join(f"k{i} string" for i in range(len(keys)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                content = row[-1]
                rows += [(*row[:-1], i, start, over, stop, forced, content[start - over : stop]) for i, (start, over, stop, forced) in enumerate(cuts(content, split))]
            yield pd.DataFrame(rows, columns=[*batch.columns[:-1], "piece", "start", "overlap", "stop", "forced", "text"])

    content = F.col(text)
    named = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    back = [F.col(f"k{i}").cast(items.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    columns = ["piece", "start", "overlap", "stop", "forced", "text"]
    long = items.where(F.length(content) > split.maximum).select(*named, content.alias("t")).mapInPandas(cut, f"{shape}, {PIECES}").select(*back, *columns)
    if only_cut:
        return long
    whole = items.where(F.length(content) <= split.maximum).select(*keys, F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("overlap"), F.length(content).alias("stop"), F.lit(False).alias("forced"), content.alias("text"))
    return long.unionByName(whole)
