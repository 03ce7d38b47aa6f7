"""Page geometry: tokens to lines, paragraphs and columns; overlap removal; cells to tables.

Steps that compare a row with the one before it are windows. Steps whose outcome depends on what was decided before (greedy
removal, running means) run in Python on one page at a time, which bounds a group by what a page holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions.scalars import overlap_share
from gaugeweave.shared import durable, sized_join

PAGE = ["doc_id", "page"]


def by_page(rows: DataFrame):
    """Groups by page, dealt over all shuffle partitions: pages are small but costly, so partitions must not be joined by their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *PAGE).groupBy(*PAGE)


def _per_page(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], extra: str = "") -> DataFrame:
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + extra
    return by_page(rows).applyInPandas(f, schema)


def text_lines(tokens: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Tokens with line_no and position: a line ends where a token's centre leaves the line's start by more than the tolerance or 0.35 of its mean height so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cy", "cx", "token_id"], kind="stable").reset_index(drop=True)
        lines, line, start, total, n = [], -1, 0.0, 0.0, 0
        for cy, h in zip(pdf["cy"], pdf["y1"] - pdf["y0"], strict=True):
            if line < 0 or abs(cy - start) > max(tolerance, 0.35 * total / n):
                line, start, total, n = line + 1, cy, 0.0, 0
            total, n = total + h, n + 1
            lines.append(line)
        pdf["line_no"] = np.array(lines, dtype="int32")
        pdf["position"] = pdf.groupby("line_no")["x0"].rank(method="first").astype("int32")
        return pdf

    return _per_page(tokens, run, ", line_no int, position int")


def split_at_gaps(lines: DataFrame, page_width: float, least_share: float = 0.2, least: float = 120.0) -> DataFrame:
    """Tokens of lines with segment: a new one after a gap of at least the share of the page's width."""
    w = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "token_id")
    gap = F.col("x0") - F.lag("x1").over(w)
    return lines.withColumn("_cut", F.when(gap >= max(least, least_share * page_width), 1).otherwise(0)).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def line_texts(lines: DataFrame) -> DataFrame:
    """One row for each line: its text in reading order, box and mean confidence."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "token_id", "text"))), lambda t: t["text"])
    return lines.groupBy(*PAGE, "line_no").agg(F.array_join(words, " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("conf"))


def paragraphs(lines: DataFrame, factor: float = 1.6, least: float = 30.0) -> DataFrame:
    """Lines with paragraph: a new one after a gap above the larger of ``least`` and ``factor`` median line heights of the page."""
    page = Window.partitionBy(*PAGE)
    w = page.orderBy("y0", "line_no")
    height = F.median(F.col("y1") - F.col("y0")).over(page)
    new = F.when(F.col("y0") - F.lag("y1").over(w) > F.greatest(F.lit(least), factor * height), 1).otherwise(0)
    return lines.withColumn("_new", new).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def header_footer(tokens: DataFrame, page_height: float, share: float = 0.08) -> DataFrame:
    """Tokens with zone: header, footer or body by their centre."""
    return tokens.withColumn("zone", F.when(F.col("cy") < share * page_height, "header").when(F.col("cy") > (1 - share) * page_height, "footer").otherwise("body"))


def outside_tables(tokens: DataFrame, tables: DataFrame, least: float = 0.5) -> DataFrame:
    """Tokens without those that lie in a table of their page by at least the share of their area."""
    box = lambda p: tuple(F.col(f"{p}.{c}") for c in ("x0", "y0", "x1", "y1"))
    same = [F.col(f"t.{c}") == F.col(f"b.{c}") for c in PAGE]
    return tokens.alias("t").join(tables.alias("b"), [*same, overlap_share(box("t"), box("b")) >= least], "left_anti")


def gap_clusters(rows: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows with cluster: values chain while each is within the tolerance of the one before."""
    w = Window.partitionBy(*key).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def mean_clusters(values: list[float], tolerance: float) -> list[list[float]]:
    """Values in order, each in the first cluster whose running mean is within the tolerance."""
    out: list[list[float]] = []
    for v in sorted(values):
        hit = next((c for c in out if abs(sum(c) / len(c) - v) <= tolerance), None)
        if hit is None:
            out.append([v])
        else:
            hit.append(v)
    return out


def _boxes(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)


def _overlap(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersection area over the smaller area, and over the union."""
    w = np.minimum(one[2], many[:, 2]) - np.maximum(one[0], many[:, 0])
    h = np.minimum(one[3], many[:, 3]) - np.maximum(one[1], many[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    a, b = (one[2] - one[0]) * (one[3] - one[1]), (many[:, 2] - many[:, 0]) * (many[:, 3] - many[:, 1])
    return both / np.maximum(np.minimum(a, b), 1e-9), both / np.maximum(a + b - both, 1e-9)


def without_overlaps(rows: DataFrame, order: list[tuple[str, bool]], least: float, measure: str = "smaller", same: str | None = None) -> DataFrame:
    """Greedy removal on each page: rows in ``order`` (column, ascending), dropping those that overlap a kept one by at least ``least``.

    ``measure``: share of the smaller box, or 'iou'. ``same``: only rows with equal values there remove each other.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_area=(pdf["x1"] - pdf["x0"]) * (pdf["y1"] - pdf["y0"])).sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable")
        boxes, kept = _boxes(pdf), []
        names = pdf[same].tolist() if same else None
        for i, box in enumerate(boxes):
            rivals = [j for j in kept if names is None or names[j] == names[i]]
            if not rivals or _overlap(box, boxes[rivals])[measure == "iou"].max() < least:
                kept.append(i)
        return pdf.iloc[kept].drop(columns="_area")

    return _per_page(rows, run)


def unique_tokens(tokens: DataFrame) -> DataFrame:
    """Without tokens that repeat a text over nearly the same place: the surer stays, then the smaller."""
    return without_overlaps(tokens, [("conf", False), ("_area", True)], 0.85, same="text")


def suppressed(boxes: DataFrame, least: float = 0.55) -> DataFrame:
    """Larger boxes first; those that overlap a kept one by more than the ratio go."""
    return without_overlaps(boxes, [("_area", False)], least, "iou")


def without_containers(cells: DataFrame, inside: float = 0.85, covered: float = 0.6) -> DataFrame:
    """Cells without those that hold at least two others which cover most of them."""
    a, b = cells.alias("a"), cells.alias("b")
    box = lambda p: tuple(F.col(f"{p}.{c}") for c in ("x0", "y0", "x1", "y1"))
    area = lambda p: (F.col(f"{p}.x1") - F.col(f"{p}.x0")) * (F.col(f"{p}.y1") - F.col(f"{p}.y0"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in PAGE]
    held = a.join(b, [*same, F.col("a.cell_id") != F.col("b.cell_id"), area("b") < area("a"), overlap_share(box("b"), box("a")) >= inside])
    full = held.groupBy(*[F.col(f"a.{c}").alias(c) for c in PAGE], F.col("a.cell_id").alias("cell_id")).agg(F.count("*").alias("n"), F.sum(area("b")).alias("s"), F.first(area("a")).alias("whole"))
    return cells.join(full.filter((F.col("n") >= 2) & (F.col("s") >= covered * F.col("whole"))), [*PAGE, "cell_id"], "left_anti")


def tables_of_cells(cells: DataFrame, page_size: float, gap_share: float = 0.02, least: float = 0.5) -> DataFrame:
    """Cells with table_id: neighbours in a row or column (overlap above a half, gap under the share of the page) belong together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes, n = _boxes(pdf), len(pdf)
        root = np.arange(n)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(n):
            a, b = boxes[i], boxes[i + 1 :]
            for lo, hi, other in ((0, 2, 1), (1, 3, 0)):
                side = np.minimum(a[other + 2], b[:, other + 2]) - np.maximum(a[other], b[:, other])
                shared = side / np.maximum(np.minimum(a[other + 2] - a[other], b[:, other + 2] - b[:, other]), 1e-9)
                gap = np.maximum(a[lo], b[:, lo]) - np.minimum(a[hi], b[:, hi])
                for j in np.flatnonzero((shared > least) & (gap < gap_share * page_size)) + i + 1:
                    x, y = find(i), find(int(j))
                    root[max(x, y)] = min(x, y)
        first = [find(i) for i in range(n)]
        names = {r: k for k, r in enumerate(sorted(set(first)))}
        return pdf.assign(table_id=np.array([names[r] for r in first], dtype="int32"))

    return _per_page(cells, run, ", table_id int")


def row_col_indices(cells: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """Cells of tables with row and col, from 0: a row is a band of tops within the share of the cell height."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["table_id", "y0", "x0", "cell_id"], kind="stable").reset_index(drop=True)
        rows, row, start, table = [], -1, 0.0, None
        for t, y, h in zip(pdf["table_id"], pdf["y0"], pdf["y1"] - pdf["y0"], strict=True):
            if t != table:
                row, start, table = 0, y, t
            elif abs(y - start) >= tolerance * h:
                row, start = row + 1, y
            rows.append(row)
        pdf["row"] = np.array(rows, dtype="int32")
        pdf["col"] = (pdf.groupby(["table_id", "row"])["x0"].rank(method="first") - 1).astype("int32")
        return pdf

    return _per_page(cells, run, ", row int, col int")


def table_bounds(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*PAGE, "table_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_cells"))


def cell_confidence(assigned: DataFrame, least: float = 0.5) -> DataFrame:
    """Per cell of a token-to-cell join: 0.4 of the covered area, 0.3 each of mean overlap and confidence; whether it should be read again."""
    area = (F.col("c_x1") - F.col("c_x0")) * (F.col("c_y1") - F.col("c_y0"))
    token = (F.col("t_x1") - F.col("t_x0")) * (F.col("t_y1") - F.col("t_y0"))
    out = assigned.groupBy("page", "cell").agg((0.4 * F.least(F.sum(token * F.col("overlap")) / F.max(area), F.lit(1.0)) + 0.3 * F.avg("overlap") + 0.3 * F.avg("conf")).alias("confidence"))
    return out.withColumn("read_again", F.col("confidence") < least)


def at_shares(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """(key, n, low, high, and a column for each share): the value at place floor(n * share), from 0, in order; exact, without a key's values in one place.

    A sketch of bounded size tells a narrow range that must hold each place (its error is at most n / accuracy); values below are counted and only the distinct
    values inside are ordered. Keys of few values need no sketch, so there are few sketches however many keys there are.
    """
    v = rows.filter(F.col(value).isNotNull())
    near = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-2 / accuracy, 2 / accuracy)]
    stats = durable(v.groupBy(*key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")))
    large = durable(stats.filter(F.col("n") > 4 * accuracy).select(*key))
    if large.isEmpty():
        stats = stats.withColumn("_b", F.lit(None).cast(f"array<{dict(rows.dtypes)[value]}>"))
    else:
        sketches = sized_join(v, large, key, "left_semi").groupBy(*key).agg(F.percentile_approx(value, near, accuracy).alias("_b"))
        stats = durable(stats.join(sketches, key, "left"))
    lo = lambda i: F.coalesce(F.when(F.lit(near[2 * i]) > 0, F.get("_b", F.lit(2 * i))), F.col("low"))
    hi = lambda i: F.coalesce(F.when(F.lit(near[2 * i + 1]) < 1, F.get("_b", F.lit(2 * i + 1))), F.col("high"))
    picks = F.array(*(F.struct(F.lit(name).alias("name"), lo(i).alias("lo"), hi(i).alias("hi"), F.floor(F.col("n") * s).alias("at")) for i, (name, s) in enumerate(shares.items())))
    wanted = stats.select(*key, F.explode(picks).alias("p")).select(*key, "p.*")
    met = v.select(*key, F.col(value).alias("_v")).groupBy(*key, "_v").agg(F.count("*").alias("_c")).join(wanted, key)
    # values below a range are one count, those inside stay apart
    met = met.filter(F.col("_v") <= F.col("hi")).withColumn("_in", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
    few = met.groupBy(*key, "name", "at", "_in").agg(F.sum("_c").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key, "name").orderBy(F.col("_in").asc_nulls_first()))
    found = few.withColumn("_upto", before).filter((F.col("_upto") > F.col("at")) & F.col("_in").isNotNull()).groupBy(*key, "name").agg(F.min("_in").alias("v"))
    wide = found.groupBy(*key).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    return stats.select(*key, "n", "low", "high").join(wide, key)


def trimmed_spread(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Difference of the values at 0.9 n and 0.1 n in order; the range of fewer than three."""
    s = at_shares(rows, key, value, {"_a": 0.1, "_z": 0.9})
    return s.select(*key, F.when(F.col("n") < 3, F.col("high") - F.col("low")).otherwise(F.col("_z") - F.col("_a")).alias("spread"))


def upper_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The value at half the count in order, not averaged."""
    return at_shares(rows, key, value, {"upper_median": 0.5}).select(*key, "upper_median")
