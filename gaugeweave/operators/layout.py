"""Page layout without drawn lines: borderless tables, chart axes, titles, line splits, grids of cells.

Each function takes what one page holds (arrays or lists of boxes), since outcomes depend on order and on running means; the frames at the
end run them page by page. A page bounds every group. Boxes are x0, y0, x1, y1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.operators.geometry import by_page

Box = tuple[float, float, float, float]
PAGE = ["doc_id", "page"]
NUMERIC = re.compile(r"\(?\s*[+-]?\s*(?:\d+\.?\d*|\.\d+|\.)\s*%?\s*\)?")
TITLE = re.compile(r"(?i)^(table|figure|fig\.?|chart|graph)\b")


def upper_median(values) -> float:
    """The value at half the count in order; 0 for none."""
    s = sorted(values)
    return float(s[len(s) // 2]) if s else 0.0


def middle(values, default: float = 0.0) -> float:
    return float(np.median(values)) if len(values) else default


# positions on one axis
def chains(values: list[float], tolerance: float) -> list[list[float]]:
    """Sorted values in groups, each within the tolerance of the one before."""
    s = sorted(values)
    cuts = [i for i in range(1, len(s)) if s[i] - s[i - 1] > tolerance]
    return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True) if b > a]


def merged_means(values: list[float], tolerance: float = 20.0) -> list[float]:
    """One position, the mean, for each chain; without a tolerance, positions by whole numbers."""
    if tolerance <= 0:
        return sorted({float(round(v)) for v in values})
    return [sum(c) / len(c) for c in chains(values, tolerance)]


def merged_halves(values: list[float], tolerance: float) -> list[float]:
    """Sorted positions in which one near the last kept moves it half way."""
    out: list[float] = []
    for v in sorted(values):
        if out and v - out[-1] <= tolerance:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(float(v))
    return out


def running_clusters(points: list[tuple[float, int]], tolerance: float) -> list[tuple[float, list[float], set[int]]]:
    """(mean, values, rows): sorted values, each in the first cluster whose running mean is within the tolerance."""
    out: list[tuple[list[float], set[int]]] = []
    for x, row in sorted(points):
        hit = next((c for c in out if abs(x - sum(c[0]) / len(c[0])) <= tolerance), None)
        if hit is None:
            out.append(([x], {row}))
        else:
            hit[0].append(x)
            hit[1].add(row)
    return [(sum(v) / len(v), v, r) for v, r in out]


def range_clusters(ranges: list[tuple[float, float]], tolerance: float) -> list[list[int]]:
    """Numbers of ranges (in order of their left ends) whose running intersection, widened by the tolerance, isn't empty."""
    spans = [tuple(sorted(r)) for r in ranges]
    out: list[list[int]] = []
    low = high = 0.0
    for i in sorted(range(len(spans)), key=lambda i: spans[i][0]):
        a, b = spans[i]
        if out and a <= high + tolerance and b >= low - tolerance:
            out[-1].append(i)
            low, high = max(low, a), min(high, b)
        else:
            out.append([i])
            low, high = a, b
    return out


def split_at_wide_gaps(values: list[float], factor: float = 1.8) -> list[list[float]]:
    """Sorted values cut at gaps above ``factor`` times their upper median; fewer than three stay together."""
    s = sorted(values)
    gaps = np.diff(s)
    wide = factor * upper_median(gaps)
    if len(s) < 3 or wide <= 0:
        return [s]
    cuts = [int(i) + 1 for i in np.flatnonzero(gaps > wide)]
    return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]


def rising(values: list[float]) -> list[float]:
    """Each value at least 1 above the one before."""
    out: list[float] = []
    for v in values:
        out.append(max(v, out[-1] + 1.0) if out and v <= out[-1] else v)
    return out


def inside_positions(values: list[float], x0: float, x1: float, least_gap: float) -> list[float]:
    """Positions inside a box by a margin, merged and rising."""
    margin = max(2.0, least_gap / 2)
    return rising(merged_halves([v for v in values if x0 + margin < v < x1 - margin], max(2.0, 0.35 * least_gap)))


def snapped(values: list[float], anchors: list[float], tolerance: float) -> list[float]:
    """Values moved to the nearest anchor within the tolerance, the smaller on ties."""
    out = []
    for v in values:
        best = min(sorted(anchors), key=lambda a: abs(v - a), default=v)
        out.append(float(best if abs(best - v) <= tolerance else v))
    return out


def rule_edges(rules: list[float], y0: float, y1: float, least_rows: int) -> list[float] | None:
    """Row edges from horizontal rules: the box's own and those well inside; None if that is too few rows."""
    margin = max(6.0, 0.01 * (y1 - y0))
    inner = sorted(y for y in rules if y0 + margin < y < y1 - margin)
    return rising([y0, *inner, y1]) if len(inner) + 1 >= least_rows else None


# boxes
def bounds(boxes) -> Box:
    a = np.asarray(boxes, float).reshape(-1, 4)
    return (float(a[:, 0].min()), float(a[:, 1].min()), float(a[:, 2].max()), float(a[:, 3].max()))


def area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def shared_area(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a: Box, b: Box) -> float:
    both = shared_area(a, b)
    return both / (area(a) + area(b) - both) if both else 0.0


def clamped(b: Box, width: float, height: float) -> Box:
    return (*(min(max(v, 0.0), m) for v, m in zip(b, (width, height, width, height), strict=True)),)


def large_enough(b: Box, width: float, height: float, share: float = 0.01) -> bool:
    return b[2] > b[0] and b[3] > b[1] and area(b) >= share * width * height


def touches(b: Box, tables: list[Box], share: float = 0.6) -> bool:
    """Whether a table covers more than a share of the box."""
    return any(shared_area(b, t) > share * max(1.0, area(b)) for t in tables)


def clipped(b: Box, tables: list[Box], width: float, height: float) -> Box:
    """The box cut at each table it meets, on the side where the table's centre lies further off, and on the other axis if that isn't enough."""
    margin = max(4.0, 0.005 * min(width, height))
    x = list(b)
    for t in tables:
        if not shared_area(tuple(x), t):
            continue
        d = [(t[k] + t[k + 2]) / 2 - (x[k] + x[k + 2]) / 2 for k in (0, 1)]
        for k in sorted((0, 1), key=lambda k: (-abs(d[k]), k)):
            if shared_area(tuple(x), t):
                if d[k] >= 0:
                    x[k + 2] = min(x[k + 2], t[k] - margin)
                else:
                    x[k] = max(x[k], t[k + 2] + margin)
    return tuple(x)


def with_near_tokens(b: Box, tokens: np.ndarray, width: float, height: float, pads: tuple[float, float, float] | None = None) -> Box:
    """The box grown to the tokens whose centre lies in it or within ``pads`` (sides, top, bottom) of it."""
    side, top, bottom = pads or (0.08 * width, 0.08 * height, 0.08 * height)
    c = (tokens[:, :2] + tokens[:, 2:]) / 2
    near = (c[:, 0] >= max(0.0, b[0] - side)) & (c[:, 0] <= min(width, b[2] + side)) & (c[:, 1] >= max(0.0, b[1] - top)) & (c[:, 1] <= min(height, b[3] + bottom))
    return bounds([b, *tokens[near]]) if near.any() else b


def best_boxes(boxes: list[Box], least: float = 0.55) -> list[int]:
    """Numbers of boxes, larger first, without those that overlap a kept one by more than the ratio."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: -area(boxes[i])):
        if not any(iou(boxes[i], boxes[k]) > least for k in kept):
            kept.append(i)
    return kept


def apart_from(tables: list[Box], sizes: list[int], existing: list[Box], least_iou: float = 0.2, least_share: float = 0.35) -> list[int]:
    """Numbers of tables, those of more cells first, that overlap neither an existing nor a kept one, in order of their tops."""
    def meet(a: Box, b: Box) -> bool:
        both = shared_area(a, b)
        return both > 0 and (iou(a, b) >= least_iou or both / max(1.0, min(area(a), area(b))) >= least_share)

    kept: list[int] = []
    for i in sorted(range(len(tables)), key=lambda i: -sizes[i]):
        if not any(meet(tables[i], o) for o in [*existing, *(tables[k] for k in kept)]):
            kept.append(i)
    return sorted(kept, key=lambda i: tables[i][1])


# lines of tokens: arrays of boxes in order of x0
def in_order(line: np.ndarray) -> np.ndarray:
    return np.argsort(line[:, 0], kind="stable")


def gaps_of(line: np.ndarray) -> np.ndarray:
    """Gaps between neighbours of an ordered line."""
    return line[1:, 0] - line[:-1, 2]


def heights_of(line: np.ndarray) -> np.ndarray:
    return np.maximum(1.0, line[:, 3] - line[:, 1])


def like_heights(line: np.ndarray, at: int, low: float = 0.75, high: float = 1.33) -> bool:
    """Whether both sides of a cut have letters of about one size."""
    h = heights_of(line)
    return low <= np.median(h[:at]) / np.median(h[at:]) <= high


def column_cuts(line: np.ndarray) -> list[int]:
    """Where an ordered line of a table is cut into cells: wide gaps between letters of one size."""
    gaps, h = gaps_of(line), middle(heights_of(line), 12.0)
    real = gaps[gaps > 0]
    if not len(real):
        return []
    wide = max(1.6 * h, 24.0) if len(real) == 1 else max(1.2 * h, 2 * float(np.median(real)))
    return [int(i) + 1 for i in np.flatnonzero((gaps > 0) & (gaps >= wide)) if like_heights(line, int(i) + 1)]


def double_space_cuts(line: np.ndarray) -> list[int]:
    """Where an ordered line of text has more than a blank between words of one size."""
    gaps, h = gaps_of(line), middle(heights_of(line), 12.0)
    real = gaps[gaps > 0]
    if not len(real):
        return []
    wide = max(0.8 * h, 2.2 * upper_median(real))
    return [int(i) + 1 for i in np.flatnonzero(gaps >= wide) if like_heights(line, int(i) + 1)]


def pieces(line: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    return np.split(line, cuts)


def capitals(text: str) -> float:
    """The share of letters that are capital."""
    letters = [c for c in text if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def height_bands(line: np.ndarray, texts: list[str], least: float = 1.35) -> list[list[int]]:
    """Token numbers of a line in bands of one height: a title and a subtitle on one baseline come apart; one band if they don't differ."""
    h = heights_of(line)
    cy = (line[:, 1] + line[:, 3]) / 2
    whole = [list(range(len(line)))]
    if len(line) < 3 or cy.max() - cy.min() < 0.45 * np.median(h) or h.max() / h.min() < least:
        return whole
    tol = max(3.0, 0.3 * float(np.median(h)))
    bands: list[list[int]] = []
    start = 0.0
    for i in np.lexsort((line[:, 0], cy)).tolist():
        if bands and abs(cy[i] - start) <= tol:
            bands[-1].append(i)
        else:
            bands.append([i])
            start = cy[i]
    bands = [sorted(b, key=lambda i: line[i, 0]) for b in bands]
    sizes = [float(np.median(h[b])) for b in bands]
    upper = [capitals(" ".join(texts[i] for i in b)) for b in bands]
    differ = len(bands) > 1 and (max(sizes) / max(1.0, min(sizes)) >= least or max(upper) >= 0.75 and min(upper) <= 0.55)
    return bands if differ else whole


def merged_lines(lines: list[np.ndarray], least: float = 0.6, ratio: float = 1.25) -> list[np.ndarray]:
    """Lines by their tops, those joined that overlap the one before by the share of the lower height and are of about one height."""
    out: list[np.ndarray] = []
    for line in sorted(lines, key=lambda x: x[:, 1].min()):
        if out:
            a, b = bounds(out[-1]), bounds(line)
            ha, hb = max(1.0, a[3] - a[1]), max(1.0, b[3] - b[1])
            if min(a[3], b[3]) - max(a[1], b[1]) >= least * min(ha, hb) and max(ha, hb) / min(ha, hb) <= ratio:
                both = np.concatenate([out[-1], line])
                out[-1] = both[np.argsort(both[:, 0] + both[:, 2], kind="stable")]
                continue
        out.append(line)
    return out


def blocks_of(lines: list[Box], factor: float = 1.6) -> list[list[int]]:
    """Numbers of lines (in order of tops) in blocks: a gap above max(12, factor * median height so far) begins a new one."""
    out: list[list[int]] = []
    for i, b in enumerate(lines):
        if out:
            h = middle([max(1.0, lines[k][3] - lines[k][1]) for k in out[-1]])
            if b[1] - lines[i - 1][3] <= max(12.0, factor * h):
                out[-1].append(i)
                continue
        out.append([i])
    return out


def standalone(paragraphs: list[list[tuple[Box, str]]], few: int = 6, big: float = 1.2, title: float = 1.35) -> list[bool]:
    """Whether each paragraph is single lines (short, large or of unlike heights) instead of running text."""
    typical = middle([max(1.0, b[3] - b[1]) for p in paragraphs for b, _ in p], 12.0)
    out = []
    for p in paragraphs:
        h = [max(1.0, b[3] - b[1]) for b, _ in p]
        n = [len(t.split()) for _, t in p]
        if len(p) == 1:
            out.append(n[0] <= few or h[0] >= big * typical)
        else:
            short = sum(n) <= few * len(p)
            out.append(short and (max(n) <= few or np.mean(h) >= big * typical) or max(h) / min(h) >= title)
    return [bool(x) for x in out]


# borderless tables
def column_starts(line: np.ndarray, texts: list[str], h: float) -> list[float]:
    """Where columns may begin in an ordered line: its first token, those after wide gaps, and numbers."""
    gaps = gaps_of(line)
    wide = max(10.0, 0.6 * h, 1.6 * upper_median(gaps[gaps > 0]))
    after = [float(x) for x, g in zip(line[1:, 0], gaps, strict=True) if g >= wide]
    return [float(line[0, 0]), *after, *(float(x) for x, t in zip(line[:, 0], texts, strict=True) if t.strip() and NUMERIC.fullmatch(t.strip()))]


def boundaries_from_centres(centres: list[float], h: float) -> list[float]:
    """Between columns that begin at ``centres``: a little before each, or half way where they are close."""
    s = sorted(centres)
    return [(a + b) / 2 if b - a < max(6.0, 0.6 * h) else b - max(1.0, 0.2 * h) for a, b in zip(s, s[1:], strict=False)]


def aligned_boundaries(lines: list[np.ndarray], texts: list[list[str]], h: float, least_cols: int = 2, least_rows: int = 2, coverage: float = 0.6) -> tuple[list[float], list[int]]:
    """(boundaries, rows): column starts that enough lines share, and the lines that have two of them; none if that is no table."""
    tol = max(8.0, 0.9 * h)
    starts = [column_starts(line, t, h) for line, t in zip(lines, texts, strict=True)]
    need = max(least_rows, round(coverage * len(lines)))
    centres = merged_halves([c for c, _, rows in running_clusters([(x, i) for i, s in enumerate(starts) for x in s], tol) if len(rows) >= need], tol)
    rows = [i for i, s in enumerate(starts) if sum(any(abs(x - c) <= tol for c in centres) for x in s) >= 2]
    if len(lines) < least_rows or len(centres) < least_cols or len(rows) < least_rows:
        return [], []
    return boundaries_from_centres(centres, h), rows


def refined(boundaries: list[float], rows: list[np.ndarray], least_gap: float, h: float) -> list[float]:
    """Boundaries moved into the gaps that rows have there: to the edge that is well aligned, else to the median middle."""
    pad, aligned = max(1.0, 0.15 * h), max(3.0, 0.35 * h)
    spread = lambda v: float(np.quantile(v, 0.9) - np.quantile(v, 0.1)) if len(v) >= 3 else float(max(v) - min(v))
    out = []
    for b in boundaries:
        gaps = []
        for line in rows:
            left = line[(line[:, 0] + line[:, 2]) / 2 <= b, 2]
            right = line[(line[:, 0] + line[:, 2]) / 2 > b, 0]
            if len(left) and len(right) and right.min() - left.max() - 2 * pad >= max(2.0, 0.4 * least_gap):
                gaps.append((left.max() + pad, right.min() - pad))
        if not gaps:
            out.append(b)
            continue
        lefts, rights = map(list, zip(*gaps, strict=True))
        sl, sr = spread(lefts), spread(rights)
        target = middle(rights) if sr <= aligned and sr <= 0.7 * sl else middle(lefts) if sl <= aligned and sl <= 0.7 * sr else middle([(x + y) / 2 for x, y in gaps])
        out.append(min(max(target, min(lefts)), max(rights)))
    return out


def with_aligned_gaps(boundaries: list[float], rows: list[np.ndarray], h: float, coverage: float, least_gap: float) -> list[float]:
    """Boundaries, and further ones where wide gaps of enough rows end at one place."""
    small, tol = max(4.0, 0.25 * h), max(6.0, 0.6 * h)
    points, ends = [], {}
    for n, line in enumerate(rows):
        gaps = gaps_of(line)
        real = gaps[gaps > 0]
        wide = max(small, 1.8 * middle(real))
        for g, left, right in zip(gaps, line[:-1, 2], line[1:, 0], strict=True):
            if g >= wide:
                points.append((float(right), n))
                ends[float(right), n] = (float(g), float(left))
    out = list(boundaries)
    for centre, values, members in running_clusters(points, tol):
        mine = [v for (x, n), v in ends.items() if n in members and x in values]
        if len(members) < max(2, round(coverage * len(rows))) or middle([g for g, _ in mine]) < max(small, least_gap / 2):
            continue
        start, left = middle(values, centre), middle([e for _, e in mine])
        new = start - max(1.0, 0.12 * h)
        new = (start + left) / 2 if new <= left + 1 else new
        if any(abs(new - b) <= tol for b in boundaries):
            continue
        near = min(range(len(out)), key=lambda k: abs(out[k] - new), default=None)
        if near is not None and abs(out[near] - new) <= max(8.0, 0.8 * h):
            out[near] = (out[near] + new) / 2
        else:
            out.append(new)
    return merged_halves(out, max(2.0, 0.45 * least_gap, 0.6 * h)) if len(out) > len(boundaries) or out != boundaries else boundaries


def borderless_tables(lines: list[tuple[np.ndarray, list[str]]], existing: list[Box] = (), least_rows: int = 2, least_cols: int = 2, coverage: float = 0.6, least_gap: float = 10.0) -> list[list[Box]]:
    """Cells of tables without drawn lines: blocks of lines whose gaps or column starts align. ``lines``: ordered boxes and texts, by their tops; tables that overlap ``existing`` go."""
    boxes = [bounds(x) for x, _ in lines]
    tables: list[list[Box]] = []
    for block in blocks_of(boxes):
        part = [lines[i] for i in block]
        h = middle([float(np.median(heights_of(x))) for x, _ in part], 12.0)
        cuts = [column_cuts(x) if len(x) > 1 else [] for x, _ in part]
        tabular = [i for i, c in enumerate(cuts) if len(c) + 1 >= least_cols]
        ranges = [(float(part[i][0][k - 1, 2]), float(part[i][0][k, 0])) for i in tabular for k in cuts[i]]
        owner = [i for i in tabular for _ in cuts[i]]
        rows, found = tabular, []
        for c in range_clusters(ranges, max(4.0, 0.4 * h)):
            if len({owner[k] for k in c}) >= max(least_rows, round(coverage * len(tabular))):
                found.append(middle([sum(ranges[k]) / 2 for k in c]))
        if len(tabular) < least_rows or len(found) + 1 < least_cols:
            found, rows = aligned_boundaries([x for x, _ in part], [t for _, t in part], h, least_cols, least_rows, coverage)
        if len(rows) < least_rows or len(found) + 1 < least_cols:
            continue
        used = [part[i][0] for i in rows]
        found = with_aligned_gaps(refined(found, used, least_gap, h), used, h, coverage, least_gap)
        x0, y0, x1, y1 = bounds(np.concatenate(used))
        xs = [x0, *inside_positions(found, x0, x1, least_gap), x1]
        tops = [bounds(x) for x in used]
        ys = rising([y0, *((a[3] + b[1]) / 2 for a, b in zip(tops, tops[1:], strict=False)), y1])
        if len(xs) - 1 >= least_cols and len(ys) - 1 >= least_rows:
            tables.append([(a, t, b, u) for t, u in zip(ys, ys[1:], strict=False) for a, b in zip(xs, xs[1:], strict=False)])
    keep = apart_from([bounds(t) for t in tables], [len(t) for t in tables], list(existing))
    return [tables[i] for i in keep]


# charts
def is_numeric_token(text: str) -> bool:
    """Whether the digits, signs and points of a text are a number."""
    return re.fullmatch(r"[-+]?\d*\.?\d+", re.sub(r"[^0-9.+-]", "", text)) is not None


def axis_clusters(numbers: np.ndarray, axis: str, width: float, height: float) -> list[np.ndarray]:
    """Groups of numeric tokens (boxes) that line up and stand at regular distances, as ticks of an axis do."""
    along, across = (1, 0) if axis == "y" else (0, 1)
    size, other = (height, width) if axis == "y" else (width, height)
    tol, real, least, spread, span = max(30.0, 0.015 * other), *((20.0, max(30.0, 0.02 * size), 0.35, 0.08) if axis == "y" else (30.0, max(50.0, 0.03 * size), 0.4, 0.15))
    if not len(numbers):
        return []
    centre = (numbers[:, :2] + numbers[:, 2:]) / 2
    out = []
    bucket = (centre[:, across] / tol).astype(int)
    for b in dict.fromkeys(bucket.tolist()):
        at = np.flatnonzero(bucket == b)
        at = at[np.argsort(centre[at, along], kind="stable")]
        if len(at) < 3:
            continue
        place = 0
        for seg in split_at_wide_gaps(centre[at, along].tolist()):
            mine = at[place : place + len(seg)]
            place += len(seg)
            gaps = np.diff(seg)
            gaps = gaps[gaps > real]
            box = bounds(numbers[mine])
            if len(seg) >= 3 and len(gaps) >= 2 and gaps.mean() >= least and (np.abs(gaps - gaps.mean()) < spread * gaps.mean()).all() and box[along + 2] - box[along] >= span * size:
                out.append(numbers[mine])
    return out


def axis_pair(y: np.ndarray, x: np.ndarray, width: float, height: float) -> Box | None:
    """The region of a y and an x axis that belong together: the x axis is low on or below the y axis, and not left of it."""
    a, b = bounds(y), bounds(x)
    span = max(1.0, a[3] - a[1])
    cy = (b[1] + b[3]) / 2
    if not a[1] + 0.2 * span <= cy <= a[3] + max(1.2 * span, 0.35 * height) or b[2] < a[0] + 0.05 * width:
        return None
    whole, px, py = bounds([a, b]), 0.1 * max(1.0, b[2] - b[0]), 0.1 * span
    return (whole[0] - px, whole[1] - py, whole[2] + px, whole[3] + py)


def axis_alone(y: np.ndarray, width: float, height: float, tables: list[Box]) -> Box | None:
    """The region right of a y axis whose x axis wasn't found: as wide as its height suggests, up to the next table."""
    a = bounds(y)
    span = max(1.0, a[3] - a[1])
    pad = min(0.06 * height, 0.25 * span)
    x0 = max(0.0, a[0] - 0.02 * width)
    x1 = min(width, x0 + min(max(0.45 * width, 2.2 * span), 0.75 * width))
    for t in tables:
        if t[0] > x0 and t[3] >= a[1] - 0.25 * span and t[1] <= a[3] + 0.25 * span:
            x1 = min(x1, t[0] - max(10.0, 0.01 * width))
    box = (x0, a[1] - pad, x1, a[3] + pad)
    return box if box[2] > box[0] and box[3] > box[1] else None


def title_region(title: Box, tokens: np.ndarray, width: float, height: float) -> Box:
    """The region below a chart's title, grown to its tokens."""
    top = min(height, title[3] + 0.01 * height)
    return clamped(with_near_tokens((max(0.0, title[0] - 0.1 * width), top, min(width, title[2] + 0.4 * width), min(height, top + 0.45 * height)), tokens, width, height), width, height)


def charts(tokens: np.ndarray, texts: list[str], tables: list[Box], titles: list[tuple[str, Box]], width: float, height: float) -> list[tuple[Box, str]]:
    """(box, method): regions by axes, by a y axis alone, and by title, grown to near tokens, cut at tables, without overlaps."""
    if not len(tokens):
        return []
    numbers = tokens[[i for i, t in enumerate(texts) if is_numeric_token(t)]]
    ys, xs = (axis_clusters(numbers, a, width, height) for a in ("y", "x"))
    found = [(box, "axis", x, y) for y in ys for x in xs if (box := axis_pair(y, x, width, height))]
    found = found or [(box, "axis_y", None, y) for y in ys if (box := axis_alone(y, width, height, tables))]
    grown = []
    for box, method, x, y in found:
        sy = max(1.0, bounds(y)[3] - bounds(y)[1])
        sx = max(1.0, bounds(x)[2] - bounds(x)[0]) if x is not None else box[2] - box[0]
        pads = (min(0.12 * width, 0.2 * sx), min(0.06 * height, 0.33 * sy), min(0.06 * height, 0.12 * sy))
        grown.append((with_near_tokens(box, tokens, width, height, pads), method))
    for text, box in titles:
        if re.search(r"(?i)\b(figure|fig\.?|chart|graph)\b", text) and large_enough(box, width, height, 0.0):
            region = title_region(box, tokens, width, height)
            if not touches(region, tables):
                grown.append((region, "title"))
    cut = [(clamped(clipped(b, tables, width, height), width, height), m) for b, m in grown]
    cut = [(b, m) for b, m in cut if large_enough(b, width, height) and not touches(b, tables, 0.0)]
    return [cut[i] for i in best_boxes([b for b, _ in cut])]


def table_titles(lines: list[tuple[Box, str]], tables: list[Box]) -> list[tuple[int | None, str, Box]]:
    """(table number from 1 or None, text, box): the line above each table that is near, beneath or wide over it and perhaps says 'Table', with one more above; then other lines that begin so."""
    h = middle([max(1.0, b[3] - b[1]) for b, t in lines if t.strip()], 12.0)
    free = {i for i, (_, t) in enumerate(lines) if t.strip()}
    out: list[tuple[int | None, str, Box]] = []

    def over(b: Box, t: Box) -> float:
        shared = max(0.0, min(b[2], t[2]) - max(b[0], t[0]))
        return max(shared / max(1.0, b[2] - b[0]), shared / max(1.0, t[2] - t[0]))

    for n, t in enumerate(tables, 1):
        far = max(2.5 * h, min(140.0, 0.15 * (t[3] - t[1])), 30.0)
        scored = []
        for i in sorted(free):
            b, text = lines[i]
            gap = t[1] - b[3]
            if -0.2 * h <= gap <= far and over(b, t) >= 0.2:
                scored.append((1 - gap / far + min(0.4, over(b, t)) + 0.6 * bool(TITLE.search(text)) + max(0.0, min(0.5, (b[3] - b[1]) / h - 1)), -i))
        if not scored:
            continue
        best = -max(scored)[1]
        mine, (b, _) = [best], lines[best]
        free.discard(best)
        for i in sorted(free, key=lambda i: -lines[i][0][3]):
            c, text = lines[i]
            tall = max(1.0, c[3] - c[1]) / max(1.0, b[3] - b[1])
            if 0 <= b[1] - c[3] <= max(0.8 * h, 18.0) and (len(text.split()) <= 8 or TITLE.search(text)) and 0.7 <= tall <= 1.2 and over(c, t) >= 0.2:
                mine.insert(0, i)
                free.discard(i)
                break
        out.append((n, "\n".join(lines[i][1].strip() for i in mine), bounds([lines[i][0] for i in mine])))
    return out + [(None, lines[i][1].strip(), lines[i][0]) for i in sorted(free) if TITLE.match(lines[i][1].strip())]


# grids of cells
def row_bands(cells: list[Box], tolerance: float = 20.0) -> list[tuple[float, float]]:
    """Bands between merged horizontal edges."""
    y = merged_means(sorted({v for c in cells for v in (c[1], c[3])}), tolerance)
    return list(zip(y, y[1:], strict=False))


def column_bounds(cells: list[Box], tolerance: float = 20.0) -> list[float]:
    return merged_means(sorted({v for c in cells for v in (c[0], c[2])}), tolerance)


def rows_by_centre(cells: list[Box]) -> list[list[int]]:
    """Numbers of cells in rows: a centre further than max(8, 0.6 of the upper median height) from the row's running mean begins a new one."""
    usable = [i for i, c in enumerate(cells) if c[3] > c[1]]
    tol = max(8.0, 0.6 * upper_median(cells[i][3] - cells[i][1] for i in usable))
    cy = lambda i: (cells[i][1] + cells[i][3]) / 2
    out: list[list[int]] = []
    for i in sorted(usable, key=lambda i: (cy(i), cells[i][0])):
        if out and abs(cy(i) - sum(map(cy, out[-1])) / len(out[-1])) <= tol:
            out[-1].append(i)
        else:
            out.append([i])
    return [sorted(r, key=lambda i: cells[i][0]) for r in out]


def inner_lines(cells: list[Box], left: float, right: float, tolerance: float) -> list[float] | None:
    """The x positions of a row's lines inside the table; None for a row of one cell."""
    if len(cells) < 2:
        return None
    return [x for x in merged_means([v for c in cells for v in (c[0], c[2])], tolerance) if x - left > tolerance and right - x > tolerance]


def same_lines(a: list[float] | None, b: list[float] | None, tolerance: float) -> bool:
    if a is None or b is None:
        return a is b
    return len(a) == len(b) and all(abs(x - y) <= tolerance for x, y in zip(a, b, strict=True))


def split_by_lines(cells: list[Box], tolerance: float = 20.0) -> list[list[int]]:
    """Numbers of a table's cells in parts: a row whose inner lines differ from those of the part's last row of several cells begins a new one; single cells stay with the part."""
    if not cells:
        return []
    left, _, right, _ = bounds(cells)
    parts: list[list[int]] = []
    last: list[float] | None = None
    for row in rows_by_centre(cells):
        lines = inner_lines([cells[i] for i in row], left, right, tolerance)
        if parts and (lines is None or last is None or same_lines(lines, last, tolerance)):
            parts[-1] += row
        else:
            parts.append(list(row))
        last = lines if lines is not None else last
    return parts


def ascii_table(rows: list[list[str]], most: int = 40) -> str:
    """A drawn table of texts: columns as wide as their longest text, up to ``most``; longer texts are cut with dots."""
    n = max(map(len, rows), default=0)
    if not n:
        return ""
    flat = [[" ".join(str(c or "").split()) for c in [*r, *[""] * (n - len(r))]] for r in rows]
    widths = [min(most, max(3, *(len(r[k]) for r in flat))) for k in range(n)]
    shown = lambda t, w: t if len(t) <= w else t[: w - 3] + "..."
    border = lambda ch: "+" + "".join(ch * (w + 2) + "+" for w in widths)
    out = [border("-")]
    for i, r in enumerate(flat):
        out += ["|" + "|".join(f" {shown(t, w):<{w}} " for t, w in zip(r, widths, strict=True)) + "|", border("=" if i == 0 and len(flat) > 1 else "-")]
    return "\n".join(out)


def ascii_replica(cells: list[tuple[Box, str]], width: int = 100) -> str:
    """A drawn copy of a grid of cells with columns as wide, in proportion, as on the page, but with room for their texts; a cell over several columns has one text."""
    if not cells:
        return ""
    boxes = [b for b, _ in cells]
    xs = column_bounds(boxes)
    if len(xs) < 2:
        return ""
    total = xs[-1] - xs[0]
    at = [0]
    for a, b in zip(xs, xs[1:], strict=False):
        texts = [len(t) for box, t in cells if abs(box[0] - a) <= 20 and abs(box[2] - b) <= 20]
        at.append(at[-1] + 1 + max(3, round(width * (b - a) / total), max(texts, default=0) + 2))
    column = lambda x: at[min(range(len(xs)), key=lambda k: abs(xs[k] - x))]
    rows = rows_by_centre(boxes)
    edges = [sorted({p for i in row for p in (column(boxes[i][0]), column(boxes[i][2]))}) for row in rows]
    border = lambda marks: "".join("+" if k in marks else "-" for k in range(at[-1] + 1))
    out = [border({0, at[-1], *edges[0]})]
    for n, row in enumerate(rows):
        line = [" "] * (at[-1] + 1)
        for i in row:
            a, b = column(boxes[i][0]), column(boxes[i][2])
            line[a] = line[b] = "|"
            line[a + 2 : a + 2 + len(cells[i][1])] = cells[i][1][: b - a - 2]
        out += ["".join(line[: at[-1] + 1]), border({0, at[-1], *edges[n], *(edges[n + 1] if n + 1 < len(edges) else [])})]
    return "\n".join(out)


def corners(points: list[tuple[float, float]], tolerance: float = 10.0) -> list[tuple[float, float]]:
    """Near points as one, at their running mean, in the order in which they come."""
    out: list[list[float]] = []
    for x, y in points:
        hit = next((c for c in out if abs(c[0] - x) <= tolerance and abs(c[1] - y) <= tolerance), None)
        if hit is None:
            out.append([x, y, 1])
        else:
            hit[0], hit[1], hit[2] = (hit[0] * hit[2] + x) / (hit[2] + 1), (hit[1] * hit[2] + y) / (hit[2] + 1), hit[2] + 1
    return [(x, y) for x, y, _ in out]


def cells_from_corners(points: list[tuple[float, float]], horizontal: list[Box], vertical: list[Box], tolerance: float = 10.0) -> list[Box]:
    """The smallest cells whose four corners and four sides exist: sides are covered by lines (boxes) within the tolerance."""
    def near(x: float, y: float) -> bool:
        return any(abs(px - x) <= tolerance and abs(py - y) <= tolerance for px, py in points)

    def along(a: float, b: float, at: float, lines: list[Box], k: int) -> bool:
        return any(abs((s[1 - k] + s[3 - k]) / 2 - at) <= tolerance and s[k] <= a + tolerance and s[k + 2] >= b - tolerance for s in lines)

    out = []
    for x, y in sorted(points, key=lambda p: (p[1], p[0])):
        rights = sorted(px for px, py in points if abs(py - y) <= tolerance and px > x + tolerance)
        belows = sorted(py for px, py in points if abs(px - x) <= tolerance and py > y + tolerance)
        cell = next(((x, y, r, b) for b in belows for r in rights if near(r, b) and along(x, r, y, horizontal, 0) and along(x, r, b, horizontal, 0) and along(y, b, x, vertical, 1) and along(y, b, r, vertical, 1)), None)
        if cell:
            out.append(cell)
    return out


# columns and frames
def scaled(tokens: DataFrame, factor: float) -> DataFrame:
    """Coordinates times a factor, as between two resolutions."""
    return tokens.withColumns({c: F.col(c) * factor for c in ("x0", "y0", "x1", "y1", "cx", "cy") if c in tokens.columns})


def table_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, cells): a table's texts by row and column, blank where there is no cell; of several the last cell_id."""
    last = cells.groupBy(*keys, "row", "col").agg(F.max_by("text", "cell_id").alias("text"))
    size = last.groupBy(*keys).agg(F.max("col").alias("_n"))
    by_row = last.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_m")).join(size, keys)
    return by_row.select(*keys, "row", F.transform(F.sequence(F.lit(0), "_n"), lambda i: F.coalesce(F.element_at("_m", i), F.lit(""))).alias("cells"))


def cell_at(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The first cell of each table at a place."""
    return cells.filter((F.col("row") == row) & (F.col("col") == col)).groupBy("doc_id", "page", "table_id").agg(F.min_by("text", "cell_id").alias("text"))


def cell_text(tokens: DataFrame, keys: list[str], char_gap: float | None = None) -> DataFrame:
    """(keys, text): a cell's tokens in reading order, parted by a blank; with ``char_gap`` letters nearer than that share of their height stay together."""
    packed = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "x0", "x1", (F.col("y1") - F.col("y0")).alias("h"), "text"))).alias("_t"))
    if char_gap is None:
        return packed.select(*keys, F.array_join(F.transform("_t", lambda t: t.text), " ").alias("text"))

    def joined(t: Column, i: Column) -> Column:
        before = F.get("_t", i - 1)
        tight = (before.line_no == t.line_no) & (t.x0 - before.x1 < char_gap * F.greatest(t.h, before.h))
        return F.concat(F.when((i == 0) | tight, "").otherwise(" "), t.text)

    return packed.select(*keys, F.array_join(F.transform("_t", joined), "").alias("text"))


def surer_tokens(tokens: DataFrame, again: DataFrame) -> DataFrame:
    """Tokens with the text and confidence of a second reading where that is surer."""
    keys = [*PAGE, "token_id"]
    best = again.groupBy(*keys).agg(F.max_by(F.struct("text", "conf"), F.struct("conf", F.col("text"))).alias("_b"))
    both = tokens.join(best, keys, "left")
    surer = F.coalesce(F.col("_b.conf") > F.col("conf"), F.lit(False))
    return both.withColumns({"text": F.when(surer, F.col("_b.text")).otherwise(F.col("text")), "conf": F.when(surer, F.col("_b.conf")).otherwise(F.col("conf"))}).select(*tokens.columns)


def page_text(tokens: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """(doc_id, page, text): tokens in lines of a fixed height: a line ends where a centre is further than the tolerance from that of its first token."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[tuple]] = []
        start = 0.0
        for cy, x0, text in sorted(zip((pdf["y0"] + pdf["y1"]) / 2, pdf["x0"], pdf["text"], strict=True)):
            if out and cy - start <= tolerance:
                out[-1].append((x0, text))
            else:
                out.append([(x0, text)])
                start = cy
        return pd.DataFrame([(*pdf[PAGE].iloc[0], "\n".join(" ".join(t for _, t in sorted(line)) for line in out))], columns=[*PAGE, "text"])

    types = dict(tokens.dtypes)
    return by_page(tokens).applyInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, text string")


def variant_matrix(spark, scales: list[float], modes: list[int], lines: list[str]) -> DataFrame:
    """(variant_no, scale, psm, lines): every way in which a table is read again."""
    rows = [(n, float(s), p, m) for n, (s, p, m) in enumerate((s, p, m) for s in scales for p in modes for m in lines)]
    return spark.createDataFrame(rows, "variant_no int, scale double, psm int, lines string")


def _page_frame(tokens: DataFrame, f: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``f`` for each page behind its keys."""
    types = dict(tokens.dtypes)
    names = [*PAGE, *(x.split()[0] for x in schema.split(", "))]
    return by_page(tokens).applyInPandas(lambda pdf: pd.DataFrame([(*pdf[PAGE].iloc[0], *r) for r in f(pdf)], columns=names), f"doc_id {types['doc_id']}, page {types['page']}, {schema}")


def _lines(pdf: pd.DataFrame) -> list[tuple[np.ndarray, list[str]]]:
    out = []
    for _, part in pdf.sort_values(["line_no", "x0"], kind="stable").groupby("line_no"):
        out.append((part[["x0", "y0", "x1", "y1"]].to_numpy(float), part["text"].tolist()))
    return sorted(out, key=lambda x: x[0][:, 1].min())


def find_borderless_tables(lines: DataFrame, **options) -> DataFrame:
    """(doc_id, page, table_no, row, col, box) of tables without drawn lines; ``lines``: tokens with line_no."""
    def run(pdf: pd.DataFrame) -> list[tuple]:
        found = []
        for n, cells in enumerate(borderless_tables(_lines(pdf), **options)):
            tops, lefts = sorted({c[1] for c in cells}), sorted({c[0] for c in cells})
            found += [(n, tops.index(c[1]), lefts.index(c[0]), *c) for c in cells]
        return found

    return _page_frame(lines, run, "table_no int, row int, col int, x0 double, y0 double, x1 double, y1 double")


def find_charts(tokens: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page, method, box) of charts, from tokens alone."""
    def run(pdf: pd.DataFrame) -> list[tuple]:
        found = charts(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), pdf["text"].tolist(), [], [], width, height)
        return [(m, *b) for b, m in found]

    return _page_frame(tokens, run, "method string, x0 double, y0 double, x1 double, y1 double")


def split_lines(lines: DataFrame, cuts: Callable[[np.ndarray], list[int]] = double_space_cuts) -> DataFrame:
    """Tokens of lines with segment, cut as ``cuts`` tells for the ordered boxes of a line."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_no", "x0"], kind="stable").reset_index(drop=True)
        segment = np.zeros(len(pdf), dtype="int32")
        for _, at in pdf.groupby("line_no").indices.items():
            for c in cuts(pdf.iloc[at][["x0", "y0", "x1", "y1"]].to_numpy(float)) if len(at) > 1 else []:
                segment[at[c:]] += 1
        return pdf.assign(segment=segment)

    schema = ", ".join(f"`{n}` {t}" for n, t in lines.dtypes) + ", segment int"
    return by_page(lines).applyInPandas(run, schema)


# repeated cells
def unique_cells(cells: list[Box], share: float = 0.05) -> list[int]:
    """Numbers of cells, smaller first, without those whose four sides are within the share of their own size of a kept one's."""
    kept: list[int] = []
    for i in sorted(range(len(cells)), key=lambda i: area(cells[i])):
        c = cells[i]
        w, h = share * (c[2] - c[0]), share * (c[3] - c[1])
        if not any(abs(c[0] - k[0]) < w and abs(c[2] - k[2]) < w and abs(c[1] - k[1]) < h and abs(c[3] - k[3]) < h for k in (cells[j] for j in kept)):
            kept.append(i)
    return kept


def merged_in_rows(cells: list[Box], least_iou: float = 0.8, least_share: float = 0.9) -> list[int]:
    """Numbers of cells without those that, in one row band, nearly repeat a larger one (the earlier one of equals)."""
    tol = max(8.0, 0.5 * upper_median(c[3] - c[1] for c in cells))
    cy = lambda i: (cells[i][1] + cells[i][3]) / 2
    bands: list[list[int]] = []
    for i in sorted(range(len(cells)), key=lambda i: (cy(i), cells[i][0])):
        if bands and abs(cy(i) - sum(map(cy, bands[-1])) / len(bands[-1])) <= tol:
            bands[-1].append(i)
        else:
            bands.append([i])
    gone: set[int] = set()
    for band in bands:
        for n, i in enumerate(band):
            for j in band[n + 1 :]:
                if i in gone or j in gone:
                    continue
                both = shared_area(cells[i], cells[j])
                if both and (iou(cells[i], cells[j]) >= least_iou or both >= least_share * max(1.0, min(area(cells[i]), area(cells[j])))):
                    gone.add(j if area(cells[i]) >= area(cells[j]) else i)
    return [i for i in range(len(cells)) if i not in gone]


def without_repeats(cells: DataFrame) -> DataFrame:
    """Cells of each page without repeated and nearly repeated ones."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = [tuple(b) for b in pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)]
        first = sorted(unique_cells(boxes))
        return pdf.iloc[[first[k] for k in merged_in_rows([boxes[i] for i in first])]]

    return by_page(cells).applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in cells.dtypes))


# totals
def page_totals(tokens: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page, tokens, tables, cells), and a row with a null page for each document's sums."""
    out = None
    for name, rows in (("tokens", tokens), ("tables", tables), ("cells", cells)):
        n = rows.select(*PAGE, F.lit(name).alias("kind"))
        out = n if out is None else out.unionByName(n)
    counts = [F.count_if(F.col("kind") == name).alias(name) for name in ("tokens", "tables", "cells")]
    return out.rollup(*PAGE).agg(*counts, F.grouping("doc_id").alias("_g")).filter("_g = 0").drop("_g")


def method_histogram(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, cells, tokens) by the way a cell was read; 'unknown' where that isn't said."""
    return cells.groupBy(*keys, F.coalesce("ocr_method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("cells"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))


def merged_histograms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms summed over what isn't in ``keys``."""
    return rows.groupBy(*keys, "method").agg(F.sum("cells").alias("cells"), F.sum("tokens").alias("tokens"))


def merged_stats(rows: DataFrame, keys: list[str], stats: str = "stats") -> DataFrame:
    """(keys, pass, name, n): nested counts (map of maps) summed by name; nulls count nothing."""
    one = rows.filter(F.col(stats).isNotNull()).select(*keys, F.explode(stats).alias("pass", "_m")).filter("_m is not null").select(*keys, "pass", F.explode("_m").alias("name", "n"))
    return one.groupBy(*keys, "pass", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
