"""Columns of pages: gutters, thin columns, and rows that are cut or not."""

import random

import numpy as np

from parcelflow.operators import glyphs, layout


def page(*columns, rows=10):
    """x0, x1 and band of words that stand in columns (from, to) in each row."""
    return np.array([a for _ in range(rows) for a, _ in columns], float), np.array([b for _ in range(rows) for _, b in columns], float), np.repeat(np.arange(rows), len(columns))


def test_gutters_lie_between_columns_alone():
    assert [tuple(np.round(g)) for g in layout.gutters(*page((0, 40), (60, 100)), 100.0)] == [(40, 60)]
    assert layout.gutters(*page((10, 100)), 100.0) == []  # a margin has text on one side only
    assert layout.gutters(*page((0, 50), (51, 100)), 100.0) == []  # narrower than a gutter
    assert len(layout.gutters(*page((0, 20), (30, 60), (70, 100)), 100.0)) == 2


def test_a_thin_column_joins_its_gutters():
    assert [tuple(np.round(g)) for g in layout.gutters(*page((0, 40), (49, 51), (60, 100)), 100.0)] == [(40, 60)]
    assert len(layout.gutters(*page((0, 40), (46, 54), (60, 100)), 100.0)) == 2


def test_few_long_lines_leave_a_gutter():
    x0, x1, band = page((0, 40), (60, 100))
    one = [np.append(c, v) for c, v in zip((x0, x1, band), (0, 100, 10), strict=True)]
    assert len(layout.gutters(*one, 100.0)) == 1
    two = [np.append(c, v) for c, v in zip(one, (0, 100, 11), strict=True)]
    assert layout.gutters(*two, 100.0) == []  # two of twelve rows are more than an eighth


def test_rows_are_cut_at_wide_gaps():
    x0, x1, band = np.array([0.0, 12, 60, 0, 90]), np.array([10.0, 20, 70, 85, 100]), np.array([0, 0, 0, 1, 1])
    assert layout.fragments(x0, x1, band, 8.0).tolist() == [0, 0, 1, 2, 2]


def test_pages_are_cut_across_batches_and_places_that_tie_have_an_order(spark):
    """Pages are longer and shorter than a batch, null numbers are pages too, and words at one place come by their text."""
    rows = [(d, p, f"w{k:04d}", k % 10 * 50.0, k // 10 * 20.0, k % 10 * 50.0 + 49, k // 10 * 20.0 + 10) for d, p, n in ((1, 1, 25), (1, 2, 1), (2, 1, 7), (3, 1, 31), (None, 1, 5), (0, 1, 12)) for k in range(n)]
    rows += [(9, 1, w, 0.0, 0.0, 5.0, 10.0) for w in "dacb"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for many in ("3", "10", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", many)
            random.Random(many).shuffle(rows)
            words = spark.createDataFrame(rows, "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double")
            found = {(r.doc, r.page): r.text for r in layout.reading_order(words).collect()}
            assert len(found) == 7 and found.pop((9, 1)) == "a b c d"
            for (d, p), text in found.items():
                own = sorted(r[2] for r in rows if r[:2] == (d, p))
                assert text == "\n".join(" ".join(own[a : a + 10]) for a in range(0, len(own), 10))
        assert layout.reading_order(words.limit(0)).count() == 0
        assert "MapInArrow" in layout.reading_order(words)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bands_beyond_one_table_of_bins_count_alike():
    many = 3 * layout.ROWS_AT_ONCE + 7
    assert [tuple(np.round(g)) for g in layout.gutters(*page((0, 40), (60, 100), rows=many), 100.0)] == [(40, 60)]
    x0, x1, band = page((0, 40), (60, 100), rows=many)
    long = range(0, many, 4)  # a quarter of the rows runs over the gutter
    assert layout.gutters(np.append(x0, np.zeros(len(long))), np.append(x1, np.full(len(long), 100.0)), np.append(band, np.array(long)), 100.0) == []


def test_glyphs_are_dealt_and_sorted_once_and_words_are_those_of_their_gaps(spark):
    rows = [
        # Twice drawn, a gap, a blank, and a line that begins within the tolerance of 3 of the line's first glyph.
        (1, 1, 1, "a", 0.0, 0.0, 5.0, 10.0), (1, 1, 2, "a", 0.01, 0.01, 5.0, 10.0), (1, 1, 3, "b", 5.0, 2.0, 10.0, 12.0), (1, 1, 4, "c", 14.0, 0.0, 19.0, 10.0), (1, 1, 5, " ", 19.0, 0.0, 20.0, 10.0),
        (1, 1, 6, "d", 20.0, 2.9, 25.0, 12.9), (1, 1, 7, "e", 0.0, 4.0, 5.0, 14.0), (1, 2, 1, "f", 0.0, 0.0, 5.0, 0.0), (1, 2, 2, "g", 0.0, 2.5, 5.0, 2.5), (2, 1, 2, "i", 5.0, 0.0, 9.0, 10.0), (2, 1, 1, "h", 0.0, 0.0, 5.0, 10.0), (3, 1, 1, " ", 0.0, 0.0, 5.0, 10.0),
    ]
    table = spark.createDataFrame(rows, "doc long, page int, seq int, text string, x0 double, top double, x1 double, bottom double")
    found = glyphs.words(table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 1, "ab", 0.0, 0.0, 10.0, 12.0), (1, 1, "c", 14.0, 0.0, 19.0, 10.0), (1, 1, "d", 20.0, 2.9, 25.0, 12.9), (1, 1, "e", 0.0, 4.0, 5.0, 14.0),
        (1, 2, "f", 0.0, 0.0, 5.0, 0.0), (1, 2, "g", 0.0, 2.5, 5.0, 2.5), (2, 1, "hi", 0.0, 0.0, 9.0, 10.0),
    ]
