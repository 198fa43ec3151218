"""Text of pages from their glyph runs: columns, lines and superscripts.

Spark deals runs out by page and sorts them; a task then lays out all pages of a batch at once, by steps over whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bins of a page's width, the least share of runs in a column's peak, the most of it that the valley may have, runs from
# which on columns are looked for, and the vertical and horizontal tolerances.
BINS, PEAK, VALLEY, LEAST, SPAN = 16, 0.15, 0.4, 20, 0.4
LINE, GAP, GLYPH = 2.5, 1.5, 0.5
SMALL, SMALLER = 0.68, 0.46


def _cites(text: Column) -> Column:
    """Whether a run is short and made of digits and signs as citations are."""
    bare = F.regexp_replace(text, r"\s+", "")
    signs = F.char_length(F.regexp_replace(bare, r"[^\d,.;:\-–—·()\[\]]", ""))
    n = F.char_length(F.trim(text))
    return F.when(text.rlike(r"\d") & (n > 0) & (n <= 24), signs >= F.char_length(bare) * 0.55).otherwise(False)


def _reading_order(page: np.ndarray, start: np.ndarray, x: np.ndarray, y: np.ndarray, ord: np.ndarray, width: float) -> np.ndarray:
    """Places of runs in reading order: of a page whose starts of runs have two peaks with a valley between, the left column down and then the
    right one; else as they came."""
    runs = np.diff(np.append(start, len(page)))
    lo, span = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start) - np.minimum.reduceat(x, start)
    wide = (runs >= LEAST) & (span >= width * SPAN) & (span > 0)
    share = np.floor((x - lo[page]) / np.where(wide, span, 1.0)[page] * BINS)
    n = np.bincount(page * BINS + np.clip(np.where(wide[page], share, 0), 0, BINS - 1).astype(np.int64), minlength=len(start) * BINS).reshape(-1, BINS)
    left, right, middle = n[:, :6].max(axis=1), n[:, 10:].max(axis=1), n[:, 6:10].min(axis=1)
    two = (wide & (left >= runs * PEAK) & (right >= runs * PEAK) & (middle < np.minimum(left, right) * VALLEY))[page]
    return np.lexsort((np.where(two, ord, 0), np.where(two, -y, 0.0), two & ~(x < (lo + span / 2)[page]), page))


def _line_numbers(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The line of each run on its page: a run joins the first line within LINE of that line's first run.  So the first run that is left begins a
    line, which takes all that are within LINE of it; a step does this for all pages."""
    line, left, k = np.zeros(len(page), np.int64), np.arange(len(page)), 0
    while len(left):
        first = np.append(True, page[left][1:] != page[left][:-1])
        seed = left[first][np.cumsum(first) - 1]
        taken = first | (np.abs(y[seed] - y[left]) <= LINE)
        line[left[taken]] = k
        left, k = left[~taken], k + 1
    return line


def _medians(page: np.ndarray, pages: int, size: np.ndarray) -> np.ndarray:
    """The middle one of each page's sizes above 0, or 0."""
    some = np.flatnonzero(size > 0)
    some = some[np.lexsort((size[some], page[some]))]
    n = np.bincount(page[some], minlength=pages)
    at = np.cumsum(n) - n + n // 2
    return np.where(n > 0, size[some][np.minimum(at, max(len(some) - 1, 0))], 0.0) if len(some) else np.zeros(pages)


def _laid_out(t: pa.Table, start: np.ndarray, keys: list[str], width: float) -> pa.RecordBatch:
    """keys, lines of whole pages, which begin at the rows start: a line's runs stand by x, a gap is a blank, and superscripts follow a ^."""
    t = t.combine_chunks()
    page = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(t))))
    x, y, size, ord = (t[f"_{c}"].to_numpy() for c in ("x", "y", "size", "ord"))
    median = _medians(page, len(start), size)
    order = _reading_order(page, start, x, y, ord, width)
    line = _line_numbers(page[order], y[order])
    by_line = np.lexsort((x[order], line, page[order]))  # stable: equal places stay in reading order
    order, line = order[by_line], line[by_line]
    page, x, size = page[order], x[order], size[order]
    text = t["_text"].combine_chunks().take(pa.array(order))
    chars, n = pc.utf8_length(text).to_numpy(), pc.utf8_length(pc.utf8_trim(text, " ")).to_numpy()
    cite = t["_cite"].to_numpy()[order]
    ratio = size / np.where(median > 0, median, 1.0)[page]
    up = (median[page] > 0) & (size > 0) & np.where(ratio < SMALLER, (n <= 8) & (cite | (n <= 3)), (ratio < SMALL) & cite)
    first = np.append(True, (page[1:] != page[:-1]) | (line[1:] != line[:-1]))
    end = x + chars * size * GLYPH
    gap = ~first & np.append(False, x[1:] - end[:-1] > GAP)
    mark = up & (first | ~np.append(False, up[:-1]))
    before = pa.array(["", " ", "^", " ^"]).take(pa.array(gap + 2 * mark))
    at = np.flatnonzero(first)
    pieces = pc.binary_join_element_wise(before, text, "")
    lines = pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(page)), pa.int32()), pieces), ""), " ")
    some = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    to = np.append(0, np.cumsum(np.bincount(page[at][some], minlength=len(start))))
    found = pa.ListArray.from_arrays(pa.array(to, pa.int32()), lines.filter(pa.array(some)))
    return pa.record_batch({**{k: t[k].combine_chunks().take(pa.array(start)) for k in keys}, "lines": found})


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose page is another than that of the row before."""
    new = np.zeros(max(len(t) - 1, 0), bool)
    for k in keys:
        c = t[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new) + 1


def page_lines(glyphs: DataFrame, keys: list[str], width: float = 612.0) -> DataFrame:
    """glyphs: keys of a page, ord, x, y, size, text.  keys, lines: each page's lines in reading order.

    A page's runs come to one task in order.  A task holds a batch and the page that it ends in.  Sizes of 0 or less count for no
    median; runs without text or place go; of equal places the earlier run comes first.
    """
    fine = glyphs.filter((F.col("text") != "") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("ord").isNotNull())
    kinds = dict(glyphs.dtypes)
    runs = fine.select(
        *keys, F.col("ord").cast("long").alias("_ord"), *[F.col(c).cast("double").alias(f"_{c}") for c in ("x", "y")],
        F.coalesce(F.abs("size"), F.lit(0.0)).cast("double").alias("_size"), F.col("text").alias("_text"), _cites(F.col("text")).alias("_cite"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of one page
        for b in batches:
            if not len(b):
                continue
            # the last row held tells whether the batch goes on with its page
            t = pa.Table.from_batches([b])
            edge = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), t]) if held else t
            begins = _begins(edge, keys) - (1 if held else 0)
            if not len(begins):
                held.append(t)
                continue
            last = int(begins[-1])
            whole = pa.concat_tables([*held, t.slice(0, last)])
            before = len(whole) - last
            yield _laid_out(whole, np.unique(np.append(0, begins[:-1] + before)), keys, width)
            held = [t.slice(last)]
        if held:
            yield _laid_out(pa.concat_tables(held), np.zeros(1, np.int64), keys, width)

    dealt = runs.repartition(*keys).sortWithinPartitions(*keys, "_ord", "_x", "_y", "_size", "_text")
    return dealt.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "lines array<string>"]))
