"""Glyphs of a page to words: glyphs drawn twice go, lines and words are found by their gaps.

Glyphs are dealt and sorted by page once, and a task takes whole pages from Arrow batches: each step is a few array
operations on the pages of a batch, so a task holds one sort and a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import page_starts, whole_pages


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where rows sorted by keys begin to differ."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _tolerances(height: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """The median height of each page's glyphs that have one; 8 where none has."""
    use = height > 0
    height, page = height[use], page[use]
    height = height[np.lexsort((height, page))]
    counts = np.bincount(page, minlength=pages)
    first, out = np.cumsum(counts) - counts, np.full(pages, 8.0)
    some = counts > 0
    low, high = (first + (counts - 1) // 2)[some], (first + counts // 2)[some]
    out[some] = 0.5 * height[low] + 0.5 * height[high]
    return out


def _lines(top: np.ndarray, page: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """A number for each glyph's line: a glyph starts a line if it lies further below the line's first than the tolerance."""
    order = np.lexsort((top, page))
    new = _first(page[order], top[order])
    tops, pages = top[order][new], page[order][new]
    line, last, at, lines = -1, 0.0, -1, []
    for y, p, most in zip(tops.tolist(), pages.tolist(), tolerance[pages].tolist(), strict=True):
        if p != at or y - last > most:
            line, last, at = line + 1, y, p
        lines.append(line)
    out = np.empty(len(top), np.int64)
    out[order] = np.array(lines)[np.cumsum(new) - 1]
    return out


def _words(gap: float, line: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pages(batches):
            starts = page_starts(table["doc"].combine_chunks(), table["page"].combine_chunks())
            page = np.zeros(len(table), np.int64)
            page[starts[1:]] = 1
            page, code = np.cumsum(page), table["text"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            # The first, by seq, of glyphs with one text at one place (to a tenth).
            near = [table[c].to_numpy() for c in ("near_x", "near_top")]
            order = np.lexsort((table["seq"].to_numpy(), *near, code, page))
            once = np.sort(order[_first(*(k[order] for k in (*near, code, page)))])
            table, page = table.take(pa.array(once)), page[once]
            seq, x0, top, x1, bottom = (table[c].to_numpy() for c in ("seq", "x0", "top", "x1", "bottom"))
            of = _lines(top, page, line * _tolerances(bottom - top, page, len(starts)))
            order = np.lexsort((seq, x0, of))
            of, x0, top, x1, bottom = (x[order] for x in (of, x0, top, x1, bottom))
            blank = table["blank"].combine_chunks().take(pa.array(order))
            white = blank.fill_null(False).to_numpy(zero_copy_only=False)
            breaks = white | _first(of)
            breaks[1:] |= white[:-1] | (x0[1:] - x1[:-1] > gap)
            keep = np.flatnonzero(~blank.fill_null(True).to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            first = np.flatnonzero(_first(np.cumsum(breaks)[keep]))
            at = order[keep]
            letters = table["text"].combine_chunks().take(pa.array(at)).to_pylist()
            texts = ["".join(letters[a:z]) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(letters)], strict=True)]
            of_page = [table[c].combine_chunks().take(pa.array(at[first])) for c in ("doc", "page")]
            ends = [f.reduceat(x[keep], first) for f, x in ((np.minimum, x0), (np.minimum, top), (np.maximum, x1), (np.maximum, bottom))]
            yield pa.RecordBatch.from_arrays([*of_page, pa.array(texts, pa.string()), *map(pa.array, ends)], names=["doc", "page", "text", "x0", "y0", "x1", "y1"])

    return run


def words(glyphs: DataFrame, gap: float = 3.0, line: float = 0.3) -> DataFrame:
    """doc, page, text, x0, y0, x1, y1 of each word of glyphs(doc, page, seq, text, x0, top, x1, bottom).

    A line's tolerance is `line` of the page's median glyph height; a word ends at white space or a gap over `gap`.
    """
    places = (F.col(c).cast("double") for c in ("x0", "top", "x1", "bottom"))
    own = glyphs.select(F.col("doc").cast("long"), F.col("page").cast("int"), F.col("seq").cast("long"), "text", *places).repartition("doc", "page").sortWithinPartitions("doc", "page")
    ready = own.withColumns({"near_x": F.round("x0", 1), "near_top": F.round("top", 1), "blank": F.col("text").rlike(r"^\s*$")})
    return ready.mapInArrow(_words(gap, line), "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double")
