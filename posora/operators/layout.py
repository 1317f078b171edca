"""Lines of a page from the boxes that a recogniser found on it.

The boxes of a page come side by side and in order, a row each, and are folded one page
at a time: the fold is sequential by nature and keeps only lines that later boxes can still join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Slopes that count, and the shares of heights within which a box belongs to a line.
STEEPEST, OF_MEDIAN, OF_LEAST = 0.35, 0.65, 0.7
#: Height of a line where a page has no box; a row of boxes is as high as this in reading order.
HEIGHT, ROW = 20.0, 10.0

POINTS = "array<array<double>>"


def page_slope(quads: np.ndarray) -> float:
    """The median slope of the upper and lower edges (x differs by one at least, slope up to STEEPEST); 0 with fewer than two."""
    if not len(quads):
        return 0.0
    left, right = quads[:, (0, 3)], quads[:, (1, 2)]
    dx, dy = (right - left)[..., 0].ravel(), (right - left)[..., 1].ravel()
    wide = np.abs(dx) >= 1
    slopes = dy[wide] / dx[wide]
    slopes = slopes[np.isfinite(slopes) & (np.abs(slopes) <= STEEPEST)]
    return float(np.median(slopes)) if len(slopes) >= 2 else 0.0


def line_of(cy: np.ndarray, height: np.ndarray, x1: np.ndarray, median: float) -> tuple[np.ndarray, np.ndarray]:
    """(line of each box, place in it), lines counted from the top.

    Boxes come by (cy, x1, place in the input); each joins the first line, by age, whose mean cy is near enough.
    """
    order = np.lexsort((np.arange(len(cy)), x1, cy))
    tall = max(OF_MEDIAN * median, OF_LEAST * float(height.max(initial=0.0)))
    made = np.zeros(len(cy), np.int64)
    sums, counts, highest, alive = [], [], [], []
    for i in order.tolist():
        c, h = cy[i], height[i]
        # boxes come from the top, so a line that lies too far above stays behind for good
        alive = [k for k in alive if c - sums[k] / counts[k] <= tall]
        for k in alive:
            if abs(sums[k] / counts[k] - c) <= max(median * OF_MEDIAN, min(highest[k], h) * OF_LEAST):
                break
        else:
            k = len(sums)
            sums.append(0.0)
            counts.append(0)
            highest.append(0.0)
            alive.append(k)
        sums[k] += c
        counts[k] += 1
        highest[k] = max(highest[k], h)
        made[i] = k
    means = np.array([s / n for s, n in zip(sums, counts, strict=True)])
    rank = np.empty(len(means), np.int64)
    rank[np.argsort(means, kind="stable")] = np.arange(len(means))
    line = rank[made]
    place = np.empty(len(cy), np.int64)
    by = np.lexsort((np.arange(len(cy)), x1, line))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(line[by])) + 1]) if len(by) else np.empty(0, np.int64)
    place[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return line, place


def _lines(quads: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, place, cy, slope, median height) of each box of a page."""
    slope = page_slope(quads)
    y = quads[..., 1] - slope * quads[..., 0]
    low, high = y.min(1, initial=np.inf), y.max(1, initial=-np.inf)
    height, cy = high - low, (low + high) / 2
    median = float(np.median(height)) if len(quads) else HEIGHT
    return *line_of(cy, height, quads[..., 0].min(1, initial=np.inf), median), cy, np.full(len(quads), slope), np.full(len(quads), median)


def _order(quads: np.ndarray) -> tuple[np.ndarray]:
    """The place of each box, from 0, when read: by (y, x) of its first corner, then moved before neighbours of its row that lie to its right."""
    first = quads[:, 0]
    read: list[int] = []
    for i in np.lexsort((np.arange(len(first)), first[:, 0], first[:, 1])).tolist():
        at = len(read)
        while at and abs(first[i, 1] - first[read[at - 1], 1]) < ROW and first[i, 0] < first[read[at - 1], 0]:
            at -= 1
        read.insert(at, i)
    place = np.empty(len(first), np.int64)
    place[read] = np.arange(len(first))
    return (place,)


def by_page(batches: Iterable[pa.RecordBatch], fold: Callable[[np.ndarray], tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """_page, _box and what ``fold`` makes of each page, for boxes that come page by page, ``_first`` with the first of each.

    At most one page and one batch of boxes are held, however many pages there are.
    """

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if not len(rows):
            return
        starts = np.flatnonzero(rows["_first"].to_numpy())
        quads = pa.concat_arrays([c.flatten() for c in rows["_q"].chunks]).to_numpy(zero_copy_only=False).reshape(-1, 4, 2)
        made = [fold(quads[s:e]) for s, e in zip(starts, [*starts[1:], len(rows)], strict=True)]
        for k, name in enumerate(names):
            rows = rows.append_column(name, pa.array(np.concatenate([m[k] for m in made])))
        yield from rows.select(["_page", "_box", *names]).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        fresh = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if not len(fresh):
            held.append(batch)
            continue
        yield from whole([*held, batch.slice(0, fresh[-1])])
        held = [batch.slice(fresh[-1])]
    if held:
        yield from whole(held)


def _folded(boxes: DataFrame, page: str, box: str, points: str | Column, fold: Callable[[np.ndarray], tuple[np.ndarray, ...]], made: dict[str, str]) -> DataFrame:
    """(_page, _box, ``made``): the boxes with four whole finite corners, each page's folded in the order of ``box``."""
    corners = F.col(points) if isinstance(points, str) else points
    rows = boxes.select(F.col(page).alias("_page"), F.col(box).alias("_box"), corners.cast(POINTS).alias("_q")).filter("_page IS NOT NULL")

    def bad(v: Column) -> Column:
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    whole = (F.size("_q") == 4) & ~F.exists("_q", lambda p: F.coalesce(F.size(p) != 2, F.lit(True))) & ~F.exists(F.flatten("_q"), bad)
    sound = rows.filter(F.coalesce(whole, F.lit(False))).withColumn("_q", F.flatten("_q"))
    # the window leaves the boxes of a page side by side and in order
    first = F.row_number().over(W.partitionBy("_page").orderBy("_box", "_q")) == 1
    schema = StructType([sound.schema["_page"], sound.schema["_box"]])
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return sound.withColumn("_first", first).mapInArrow(lambda batches: by_page(batches, fold, list(made)), schema)


def reading_order(boxes: DataFrame, page: str, box: str, points: str | Column) -> DataFrame:
    """(page, box, place): the order in which the boxes of a page are read, from 0; see ``document_lines`` for boxes that are left out."""
    return _folded(boxes, page, box, points, _order, {"place": "long"}).withColumnsRenamed({"_page": page, "_box": box})


def document_lines(boxes: DataFrame, page: str, box: str, points: str | Column) -> DataFrame:
    """(page, box, line, place, cy, slope, median_height): the line of each box, from the top, and its place from the left.

    ``points`` are four corners [x, y] from the upper left on, clockwise. Boxes without four whole finite corners
    and rows without a page are left out; equal boxes stand side by side in the order of ``box`` (nulls first).
    """
    found = _folded(boxes, page, box, points, _lines, {"line": "long", "place": "long", "cy": "double", "slope": "double", "median_height": "double"})
    return found.withColumnsRenamed({"_page": page, "_box": box})
