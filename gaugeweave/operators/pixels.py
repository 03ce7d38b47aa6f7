"""Rules, white valleys and the grid of a page's picture.

Pictures are rows (keys, width, height, pixels): one byte a pixel, row by row, 0 black; regions are rows (keys, region, x0, y0, x1, y1), or, so that no picture need be
shuffled, a column ``regions`` of the pictures (an array of such structs) where regions are None. A picture and its regions
are looked at in one task, in Arrow batches that Spark bounds by bytes; what comes out are narrow rows (connected strokes, valleys), which plans of built-in functions merge.
:func:`looked_at` finds both in one pass.

Results for odd input: a picture whose pixels are null or not width times height, and a region without 10 by 30 pixels inside its picture, give no rows; regions reach no further than the
picture; a picture of one shade has no rules; a null region stands for no region.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.shared import durable

LEAST_HEIGHT, LEAST_WIDTH = 10, 30


def dark(grey: np.ndarray) -> np.ndarray:
    """Pixels at or below the threshold that parts the shades best (greatest variance between the classes, the least such threshold)."""
    share = np.bincount(grey.ravel(), minlength=256) / grey.size
    q, m = np.cumsum(share), np.cumsum(share * np.arange(256))
    ok = (q > 1e-7) & (q < 1 - 1e-7)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, q * (1 - q) * (m / q - (m[-1] - m) / (1 - q)) ** 2, 0.0)
    return grey <= int(between.argmax())


def _along(x: np.ndarray, before: int, after: int, axis: int, any_: bool) -> np.ndarray:
    """Whether any pixel, or each, of the window around each is set; what lies outside the picture doesn't count."""
    n, x = x.shape[axis], x.astype(bool, copy=False)
    if before + after < 8:  # few shifts are quicker than sums
        out = x.copy()
        side = (lambda s: (s,)) if axis == 0 else (lambda s: (slice(None), s))
        for k in [*range(-before, 0), *range(1, after + 1)]:
            if abs(k) < n:
                here, there = (side(slice(0, n - k)), side(slice(k, n))) if k > 0 else (side(slice(-k, n)), side(slice(0, n + k)))
                out[here] = out[here] | x[there] if any_ else out[here] & x[there]
        return out
    sums = np.zeros([m + (i == axis) for i, m in enumerate(x.shape)], np.int32)
    np.cumsum(x, axis=axis, dtype=np.int32, out=sums[1:] if axis == 0 else sums[:, 1:])
    lo, hi = np.maximum(np.arange(n) - before, 0), np.minimum(np.arange(n) + after + 1, n)
    found = sums.take(hi, axis) - sums.take(lo, axis)
    return found > 0 if any_ else found == ((hi - lo)[:, None] if axis == 0 else hi - lo)


def grown(x: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    return _along(x, before, after, axis, True)


def shrunk(x: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    return _along(x, before, after, axis, False)


def long_strokes(ink: np.ndarray) -> np.ndarray:
    """What is left of the ink after gaps of two pixels are closed and all that is narrower than 35 % of the width is taken away."""
    closed = grown(grown(ink, 1, 1, 0), 1, 1, 1)
    closed = shrunk(shrunk(closed, 1, 1, 0), 1, 1, 1)
    n = max(int(ink.shape[1] * 0.35), 40)
    a, b = n // 2, n - 1 - n // 2
    # of a run the middles of such strokes are kept and grown again: what a window finds, told from the ends of the run
    ys, first, last = runs(closed)
    out, end = np.zeros(closed.shape, bool), closed.shape[1] - 1
    lo, hi = np.where(first == 0, 0, first + a), np.where(last == end, end, last - b)
    ok = lo <= hi
    for y, s, e in zip(ys[ok].tolist(), np.maximum(lo - b, 0)[ok].tolist(), np.minimum(hi + a, end)[ok].tolist(), strict=True):
        out[y, s : e + 1] = True
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first, last) of all runs of set pixels, line by line."""
    wide = np.zeros((x.shape[0], x.shape[1] + 2), bool)
    wide[:, 1:-1] = x
    at = np.flatnonzero(wide[:, 1:] != wide[:, :-1])
    ys, xs = np.divmod(at, x.shape[1] + 1)
    return ys[::2], xs[::2], xs[1::2] - 1


def connected(strokes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of connected parts, corners included: runs of each line joined with those they touch in the line before."""
    parent: list[int] = []
    boxes: list[list[int]] = []
    last: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y, line in groupby(zip(*(v.tolist() for v in runs(strokes)), strict=True), key=lambda r: r[0]):
        here = []
        for _, s, e in line:
            i = len(parent)
            parent.append(i)
            boxes.append([s, y, e, y])
            for s2, e2, j in last:
                if boxes[j][3] >= y - 1 and s2 <= e + 1 and e2 >= s - 1:
                    a, b = root(i), root(j)
                    if a != b:
                        parent[b] = a
                        p, q = boxes[a], boxes[b]
                        boxes[a] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
            here.append((s, e, i))
        last = [(s, e, root(i)) for s, e, i in here]
        for _, _, i in last:
            boxes[i][3] = max(boxes[i][3], y)
    return [(b[0], b[1], b[2] - b[0] + 1, b[3] - b[1] + 1) for i, b in enumerate(boxes) if parent[i] == i]


def smooth_ink(ink: np.ndarray, text_height: float) -> np.ndarray:
    """Dark pixels of each column, averaged over an odd window of about half a text's height."""
    window = max(3, round(max(3.0, text_height * 0.5)))
    window += window % 2 == 0
    return np.convolve(ink.sum(axis=0).astype(float), np.ones(window) / window, mode="same")


def valleys(ink: np.ndarray, text_height: float) -> list[int]:
    """The emptiest column of each stretch of at least half a text's height with next to no ink."""
    smooth = smooth_ink(ink, text_height)
    order = np.sort(smooth)
    at, part = divmod((len(order) - 1) * 0.2, 1)
    fifth = order[int(at)] + (order[min(int(at) + 1, len(order) - 1)] - order[int(at)]) * part
    least = max(1.0, min(float(order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2 * 0.35, float(fifth) * 1.2))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (smooth <= least).astype(np.int8), [0]])))
    width = max(2, round(text_height * 0.5))
    return [int(s + smooth[s:e].argmin()) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s >= width]


_TYPES = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _looked_at(pictures: DataFrame, regions: DataFrame | None, keys: list[str], look, out: str) -> DataFrame:
    """(keys, region, box, ...): what ``look`` gives for the part of each picture in each of its regions. A page's regions are few, so they travel with its picture."""
    kinds = dict(pictures.dtypes)
    if regions is None:
        whole = pictures.select(*keys, "width", "height", "pixels", F.col("regions").alias("_boxes"))
    else:
        more = [c for c in ("text_height",) if c in regions.columns]
        boxes = regions.filter("region is not null").groupBy(*keys).agg(F.collect_list(F.struct("region", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", *more)))).alias("_boxes"))
        whole = pictures.select(*keys, "width", "height", "pixels").join(boxes, keys)
    box = ("x0", "y0", "x1", "y1")
    columns = [x.split() for x in out.split(", ")]
    names = [*keys, "region", *box, *(c for c, _ in columns)]
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, which, rows = [], [], []
            for i, (w, h, pixels, boxes_) in enumerate(zip(*(batch.column(k + n).to_pylist() for n in range(4)), strict=True)):
                if pixels is None or not w or not h or len(pixels) != w * h:
                    continue
                grey = np.frombuffer(pixels, np.uint8).reshape(int(h), int(w))
                for b in boxes_ or []:
                    if b is None or b["region"] is None or any(b[c] is None for c in box):
                        continue
                    x0, y0, x1, y1 = (round(b[c]) for c in box)
                    x0, y0 = max(0, min(x0, grey.shape[1] - 1)), max(0, min(y0, grey.shape[0] - 1))
                    part = grey[y0 : max(0, y1), x0 : max(0, x1)]
                    if part.shape[0] >= LEAST_HEIGHT and part.shape[1] >= LEAST_WIDTH:
                        found = look(part, x0, y0, b)
                        at += [i] * len(found)
                        which += [b] * len(found)
                        rows += found
            place = pa.array(at, pa.int64())
            told = [pa.array([b["region"] for b in which], batch.schema.field(k + 3).type.value_type.field("region").type), *(pa.array([float(b[c]) for b in which], pa.float64()) for c in box)]
            found = [pa.array([r[n] for r in rows], _TYPES[t]) for n, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(place) for n in range(k)), *told, *found], names=names)

    region = whole.schema["_boxes"].dataType.elementType["region"].dataType.simpleString()
    return whole.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"region {region}", *(f"{c} double" for c in box), out]))


def _strokes(ink: np.ndarray, y0: int) -> list[tuple]:
    return [(y0, y, w, h, ink.shape[1], ink.shape[0]) for x, y, w, h in connected(long_strokes(ink))]


def strokes(pictures: DataFrame, regions: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, region, box, top, wide, high, width, height): the long strokes of each region of ``width`` by ``height`` pixels, tops from the region's own."""
    return _looked_at(pictures, regions, keys, lambda part, x0, y0, b: _strokes(dark(part), y0), "above int, top int, wide int, high int, width int, height int")


def looked_at(pictures: DataFrame, regions: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`strokes` and :func:`white_valleys` of one look at each picture."""

    def look(part: np.ndarray, x0: int, y0: int, b: dict) -> list[tuple]:
        ink = dark(part)
        return [(None, *s) for s in _strokes(ink, y0)] + [(float(x0 + x), *[None] * 6) for x in valleys(ink, b.get("text_height") or 12.0)]

    both = durable(_looked_at(pictures, regions, keys, look, "x double, above int, top int, wide int, high int, width int, height int"))
    return both.filter("x is null").drop("x"), both.filter("x is not null").select(*keys, "region", "x0", "y0", "x1", "y1", "x")


def rules(pictures: DataFrame, regions: DataFrame | None, keys: list[str], least_share: float = 0.45, most_thick: float = 0.02, tolerance: float = 3.0) -> DataFrame:
    """:func:`rules_of` the strokes of pictures."""
    return rules_of(strokes(pictures, regions, keys), keys, least_share, most_thick, tolerance)


def rules_of(strokes_: DataFrame, keys: list[str], least_share: float = 0.45, most_thick: float = 0.02, tolerance: float = 3.0) -> DataFrame:
    """(keys, region, box, ys): the middles of thin strokes of at least ``least_share`` of the region's width, those within ``tolerance`` of the one before taken together; regions without any are left out."""
    thin = F.col("high") <= F.greatest(F.lit(3), F.floor(F.least("height", "width") * F.lit(most_thick)))
    wide = F.col("wide") >= F.greatest(F.lit(1), F.floor(F.col("width") * F.lit(least_share)))
    found = strokes_.filter(thin & wide).groupBy(*keys, "region", "x0", "y0", "x1", "y1", "above").agg(F.sort_array(F.collect_list(F.col("top") + F.col("high") / 2.0)).alias("_ys"))
    near = lambda done, y: F.abs(y - F.element_at(done, -1)) <= tolerance
    joined = F.aggregate("_ys", F.array().cast("array<double>"), lambda done, y: F.when(F.size(done) == 0, F.array(y)).when(near(done, y), F.concat(F.slice(done, 1, F.size(done) - 1), F.array((F.element_at(done, -1) + y) / 2))).otherwise(F.concat(done, F.array(y))))
    return found.select(*keys, "region", "x0", "y0", "x1", "y1", F.transform(joined, lambda y: y + F.col("above")).alias("ys"))


def white_valleys(pictures: DataFrame, regions: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, region, box, x): columns next to no ink, by the region's ``text_height`` (12 where there is none)."""
    look = lambda part, x0, y0, b: [(float(x0 + x),) for x in valleys(dark(part), b.get("text_height") or 12.0)]
    return _looked_at(pictures, regions, keys, look, "x double")


def _rising(values, start):
    """Each value at least 1 above the one before."""
    return F.aggregate(values, start, lambda done, v: F.concat(done, F.array(F.when((F.size(done) > 0) & (v <= F.element_at(done, -1)), F.element_at(done, -1) + 1.0).otherwise(v))))


def ruled_rows(rules_: DataFrame, keys: list[str], least_rows: int = 2) -> DataFrame:
    """(keys, region, box, edges): row edges from rules, the box's own and those well inside it; regions with too few rows are left out."""
    margin = F.greatest(F.lit(6.0), (F.col("y1") - F.col("y0")) * 0.01)
    inner = F.filter("ys", lambda y: (y > F.col("y0") + margin) & (y < F.col("y1") - margin))
    few = rules_.withColumn("_inner", inner).filter(F.size("_inner") + 1 >= least_rows)
    return few.select(*keys, "region", "x0", "y0", "x1", "y1", _rising(F.concat(F.array("y0"), F.array_sort("_inner"), F.array("y1")), F.array().cast("array<double>")).alias("edges"))


def snapped_boundaries(boundaries: DataFrame, anchors: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """``boundaries`` (keys, region, x) moved to the nearest anchor (keys, region, x) within the tolerance, the smaller on ties.

    The nearest anchors on both sides are the last one before and the first one after in the order of x, so no boundary meets all anchors.
    """
    both = boundaries.select(*keys, "region", "x", F.lit(True).alias("own")).unionByName(anchors.select(*keys, "region", "x", F.lit(False).alias("own")))
    w = Window.partitionBy(*keys, "region").orderBy("x")
    anchor = F.when(~F.col("own"), F.col("x"))
    left, right = F.last(anchor, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first(anchor, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.when(F.coalesce(F.col("x") - F.col("_l"), F.lit(float("inf"))) <= F.coalesce(F.col("_r") - F.col("x"), F.lit(float("inf"))), F.col("_l")).otherwise(F.col("_r"))
    placed = both.withColumns({"_l": left, "_r": right}).filter("own").withColumn("_near", near)
    return placed.select(*keys, "region", F.when(F.abs(F.col("_near") - F.col("x")) <= tolerance, F.col("_near")).otherwise(F.col("x")).alias("x"))


def grid(rows: DataFrame, boundaries: DataFrame, keys: list[str], least_gap: float = 10.0) -> DataFrame:
    """(keys, region, row, col, x0, y0, x1, y1): cells between row edges and the column boundaries well inside the box, those nearer than 0.35 ``least_gap`` (2 at least) taken together."""
    near, margin = max(2.0, 0.35 * least_gap), max(2.0, least_gap / 2)
    xs = boundaries.groupBy(*keys, "region").agg(F.sort_array(F.collect_list("x")).alias("_xs"))
    inside = F.filter(F.coalesce("_xs", F.array().cast("array<double>")), lambda x: (x > F.col("x0") + margin) & (x < F.col("x1") - margin))
    joined = F.aggregate(inside, F.array().cast("array<double>"), lambda done, x: F.when((F.size(done) > 0) & (x - F.element_at(done, -1) <= near), F.concat(F.slice(done, 1, F.size(done) - 1), F.array((F.element_at(done, -1) + x) / 2))).otherwise(F.concat(done, F.array(x))))
    whole = rows.join(xs, [*keys, "region"], "left").withColumn("_x", F.concat(F.array("x0"), _rising(joined, F.array().cast("array<double>")), F.array("x1")))
    each = whole.select(*keys, "region", "_x", F.posexplode(F.arrays_zip(F.slice("edges", 1, F.size("edges") - 1).alias("y0"), F.slice("edges", 2, F.size("edges") - 1).alias("y1"))).alias("row", "_y"))
    each = each.select(*keys, "region", "row", "_y", F.posexplode(F.arrays_zip(F.slice("_x", 1, F.size("_x") - 1).alias("x0"), F.slice("_x", 2, F.size("_x") - 1).alias("x1"))).alias("col", "_c"))
    return each.select(*keys, "region", "row", "col", "_c.x0", "_y.y0", "_c.x1", "_y.y1")
