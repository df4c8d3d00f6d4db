"""Reading order of positioned words: bands of rows, columns between gutters, lines of text.

Words are dealt and sorted by page, so a task reads page after page from Arrow batches. The running means depend on the
words' order; all else of a page is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, OCCUPIED, GUTTER, THIN = 240, 0.12, 0.025, 0.05
#: Bands that are held against the bins at once.
ROWS_AT_ONCE = 1024
_SCHEMA = "doc long, page int, text string"


def bands(middle: np.ndarray, tolerance: float) -> np.ndarray:
    """The band of each word (sorted by middle): it joins the last band if near that band's running mean."""
    out, mean, n, band = [], 0.0, 0, -1
    for y in middle.tolist():
        if n and abs(y - mean) <= tolerance:
            mean, n = (mean * n + y) / (n + 1), n + 1
        else:
            band, mean, n = band + 1, y, 1
        out.append(band)
    return np.array(out, int)


def gutters(x0: np.ndarray, x1: np.ndarray, band: np.ndarray, width: float) -> list[tuple[float, float]]:
    """The vertical gaps that few bands cross, with text on both sides; gaps with a thin column between them are one."""
    low = np.clip((x0 / width * BINS).astype(np.int64), 0, BINS)
    high = np.clip(np.maximum(low + 1, np.ceil(x1 / width * BINS).astype(np.int64)), 0, BINS)
    order = np.argsort(band, kind="stable")
    held, cuts = np.zeros(BINS, np.int64), np.searchsorted(band[order], np.arange(0, band.max() + 1, ROWS_AT_ONCE))
    for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(order)], strict=True)):  # bounded tables of bands by bins
        own = order[a:z]
        rows = ROWS_AT_ONCE if len(cuts) > 1 else int(band.max()) + 1
        cell = (band[own] - k * ROWS_AT_ONCE) * (BINS + 1)
        edges = np.bincount(cell + low[own], minlength=rows * (BINS + 1)) - np.bincount(cell + high[own], minlength=rows * (BINS + 1))
        held += (np.cumsum(edges.reshape(rows, BINS + 1), axis=1)[:, :BINS] > 0).sum(axis=0)
    free = held <= OCCUPIED * (band.max() + 1)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    found: list[tuple[float, float]] = []
    for start, i in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        left, right = start / BINS * width, i / BINS * width
        if (i - start) / BINS >= GUTTER and (x1 <= left + 1e-6).any() and (x0 >= right - 1e-6).any():
            if found and left - found[-1][1] < THIN * width:
                left = found.pop()[0]
            found.append((left, right))
    return found


def fragments(x0: np.ndarray, x1: np.ndarray, band: np.ndarray, least: float) -> np.ndarray:
    """The fragment of each word: a row's words from left to right, cut where a gap of least or more is."""
    order = np.lexsort((x0, band))
    cut = np.ones(len(order), bool)
    cut[1:] = (np.diff(band[order]) != 0) | (x0[order][1:] - x1[order][:-1] >= least)
    out = np.zeros(len(order), int)
    out[order] = np.cumsum(cut) - 1
    return out


def page_text(text: list[str], x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> str:
    """The words of a page in reading order: column by column, line by line. They come by middle and x0.

    A row is cut only where its own gap is comparable to a gutter, and each fragment goes to the column of its middle: a
    long line that runs over a gutter stays whole.
    """
    middle, tolerance = (y0 + y1) / 2, 0.6 * float(np.median(y1 - y0))
    band, width = bands(middle, tolerance), float(x1.max()) or 1.0
    cuts = gutters(x0, x1, band, width)
    column, line = np.zeros(len(text), int), band
    if cuts:
        of = fragments(x0, x1, band, max(0.4 * min(b - a for a, b in cuts), 0.03 * width))
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        spans = (np.minimum.reduceat(x0[order], starts) + np.maximum.reduceat(x1[order], starts)) / 2
        column, line = np.searchsorted([(a + b) / 2 for a, b in cuts], spans, side="right")[of], np.zeros(len(text), int)
        for c in np.unique(column):
            own = column == c
            line[own] = bands(middle[own], tolerance)
    order = np.lexsort((x0, line, column))
    ends = np.flatnonzero((np.diff(column[order]) != 0) | (np.diff(line[order]) != 0)) + 1
    words = [text[i] for i in order.tolist()]
    return "\n".join(" ".join(words[a:z]) for a, z in zip([0, *ends.tolist()], [*ends.tolist(), len(words)], strict=True))


def boxes_of_words(words: DataFrame) -> DataFrame:
    """Boxes of a PDF reader's words(doc, page, text, x0, top, x1, bottom); blank ones go."""
    return words.where("trim(text) <> ''").select("doc", "page", "text", "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"))


def boxes_of_scans(words: DataFrame, least: int = 0) -> DataFrame:
    """Boxes of a recogniser's words(doc, page, text, left, top, width, height, conf); blank and unsure ones go.

    conf is text; what isn't a number counts as -1.
    """
    sure = F.coalesce(F.col("conf").try_cast("double").cast("int"), F.lit(-1)) >= least
    text = F.trim(F.coalesce("text", F.lit("")))
    return words.where(sure & (text != "")).select("doc", "page", text.alias("text"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))


def boxes_of_shares(words: DataFrame) -> DataFrame:
    """Boxes of words(doc, page, text, x0, y0, x1, y1, page_width, page_height) placed by shares of the page."""
    text = F.trim(F.coalesce("text", F.lit("")))
    scaled = ((F.col(c) * F.col(size)).alias(c) for c, size in (("x0", "page_width"), ("y0", "page_height"), ("x1", "page_width"), ("y1", "page_height")))
    return words.where(text != "").select("doc", "page", text.alias("text"), *scaled)


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by doc and page as tables of whole pages; a page that a batch's end cuts waits for the next one."""
    held: list[pa.RecordBatch] = []
    table = lambda rows: pa.Table.from_batches(rows).combine_chunks()
    for batch in batches:
        if not batch.num_rows:
            continue
        last = page_starts(batch["doc"], batch["page"])[-1]
        if held and last == 0 and _one_page(held[-1], batch):
            held.append(batch)
            continue
        if last == 0:  # the batch is one page, and another than what is held
            if held:
                yield table(held)
            held = [batch]
            continue
        yield table([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield table(held)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, page and text of each page of words sorted by page."""
    for table in whole_pages(batches):
        doc, page = table["doc"].combine_chunks(), table["page"].combine_chunks()
        x0, y0, x1, y1 = (table[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        words, starts = table["text"].to_pylist(), page_starts(doc, page)
        texts = [page_text(words[a:z], x0[a:z], y0[a:z], x1[a:z], y1[a:z]) for a, z in zip(starts, [*starts[1:], len(words)], strict=True)]
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(starts)), page.take(pa.array(starts)), pa.array(texts, pa.string())], names=["doc", "page", "text"])


def page_starts(doc: pa.Array, page: pa.Array) -> list[int]:
    """Where pages begin among rows sorted by page; a null number is one of its own."""
    new = np.zeros(len(doc), bool)
    new[0] = True
    for key in (doc, page):
        missing, value = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False)
        new[1:] |= (np.diff(value) != 0) | (missing[1:] != missing[:-1])
    return np.flatnonzero(new).tolist()


def _one_page(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a[c][-1].as_py() == b[c][0].as_py() for c in ("doc", "page"))


def reading_order(words: DataFrame) -> DataFrame:
    """doc, page and text of words(doc, page, text, x0, y0, x1, y1).

    Spark deals words to tasks by page and sorts them, so words at one place have an order too; a task takes page by page.
    """
    boxes = words.select(F.col("doc").cast("long"), F.col("page").cast("int"), F.col("text").cast("string"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    middle = (F.col("y0") + F.col("y1")) / 2
    return boxes.repartition("doc", "page").sortWithinPartitions("doc", "page", middle, "x0", "x1", "y0", "text").mapInArrow(_pages, _SCHEMA)
