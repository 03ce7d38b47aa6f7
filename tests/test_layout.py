"""Positions, boxes, line splits, borderless tables, charts, titles, grids of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import layout as L


def test_positions():
    assert L.chains([5, 1, 2, 9], 1) == [[1, 2], [5], [9]] and L.chains([], 1) == []
    assert L.merged_means([10, 20, 100], 15) == [15, 100] and L.merged_means([1.4, 1.2, 2.6], 0) == [1.0, 3.0]
    assert L.merged_halves([0, 4, 6, 50], 5) == [4.0, 50.0]  # (0 + 4) / 2 = 2, (2 + 6) / 2 = 4
    assert [(c, r) for c, _, r in L.running_clusters([(10, 0), (12, 1), (30, 1)], 5)] == [(11, {0, 1}), (30, {1})]
    assert L.range_clusters([(0, 10), (8, 20), (12, 30), (50, 40)], 0) == [[0, 1], [2], [3]]
    assert L.split_at_wide_gaps([1, 2, 3, 9, 10]) == [[1, 2, 3], [9, 10]] and L.split_at_wide_gaps([1, 9]) == [[1, 9]]
    assert L.rising([1, 1, 0.5, 5]) == [1, 2.0, 3.0, 5]
    assert L.inside_positions([1, 50, 51, 99], 0, 100, 10) == [50.5]
    assert L.snapped([9, 20], [10, 40], 2) == [10.0, 20.0] and L.snapped([3], [], 1) == [3.0]
    assert L.rule_edges([1, 50, 99.5], 0, 100, 2) == [0, 50, 100] and L.rule_edges([1], 0, 100, 2) is None


def test_boxes():
    a, b = (0, 0, 10, 10), (5, 0, 15, 10)
    assert L.iou(a, b) == pytest.approx(1 / 3) and L.iou(a, (20, 20, 30, 30)) == 0 and L.shared_area(a, b) == 50
    assert L.clamped((-5, 2, 50, 9), 20, 8) == (0.0, 2, 20, 8) and not L.large_enough((0, 0, 1, 1), 100, 100) and L.large_enough(a, 100, 100)
    assert L.touches(a, [b], 0.4) and not L.touches(a, [b], 0.6)
    x = L.clipped((0, 0, 100, 100), [(80, 20, 200, 60)], 1000, 1000)
    assert x[2] == 75 and L.shared_area(x, (80, 20, 200, 60)) == 0
    assert L.with_near_tokens((10, 10, 20, 20), np.array([[19, 19, 30, 22], [500, 500, 510, 510]]), 100, 100) == (10, 10, 30, 22)
    assert L.best_boxes([a, (0, 0, 9, 10), (50, 50, 60, 60)]) == [0, 2]
    assert L.apart_from([a, (0, 0, 9, 10), (50, 5, 60, 60), (70, 0, 80, 9)], [1, 2, 3, 1], [(70, 0, 80, 9)]) == [1, 2]


def line(y, *spans, h=10):
    return np.array([[x0, y, x1, y + h] for x0, x1 in spans], float)


def test_line_splits():
    x = line(0, (0, 20), (25, 45), (50, 70), (150, 170))
    assert L.column_cuts(x) == [3] and L.double_space_cuts(x) == [3] and [len(p) for p in L.pieces(x, [3])] == [3, 1]
    unlike = np.array([[0, 0, 20, 10], [25, 0, 45, 10], [150, 0, 170, 30]], float)
    assert L.column_cuts(unlike) == [] and L.column_cuts(line(0, (0, 20), (60, 80))) == [1] and L.column_cuts(line(0, (0, 9), (5, 20))) == []
    title = np.concatenate([line(0, (0, 50), (60, 110), h=30), line(22, (120, 150), (160, 190), h=10)])
    assert L.height_bands(title, ["BIG", "TITLE", "small", "words"]) == [[0, 1], [2, 3]] and L.height_bands(line(0, (0, 5), (6, 9)), ["a", "b"]) == [[0, 1]]
    assert len(L.merged_lines([line(0, (0, 10)), line(2, (20, 30)), line(40, (0, 9))])) == 2
    assert L.blocks_of([(0, 0, 9, 10), (0, 14, 9, 24), (0, 80, 9, 90)]) == [[0, 1], [2]]
    b = lambda h: (0.0, 0.0, 9.0, float(h))
    long = "one two three four five six seven eight"
    assert L.standalone([[(b(10), "short")], [(b(10), long)], [(b(20), long)], [(b(10), long), (b(10), long)], [(b(10), long), (b(14), long)]]) == [True, False, True, False, True]
    assert L.capitals("Ab1") == 0.5 and L.capitals("1") == 0.0


def grid(cols=3, rows=4, x=100, y=50, h=12):
    lines = []
    for r in range(rows):
        boxes = [[x + 120 * c, y + 20 * r, x + 120 * c + 40, y + 20 * r + h] for c in range(cols)]
        lines.append((np.array(boxes, float), [f"{r}.{c}" if c else f"row{r}" for c in range(cols)]))
    return lines


def test_borderless_tables():
    (cells,) = L.borderless_tables(grid())
    assert len(cells) == 12 and L.bounds(cells) == (100, 50, 380, 122)
    for r, (boxes, _) in enumerate(grid()):
        for c, box in enumerate(boxes):
            cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
            assert [i for i, b in enumerate(cells) if b[0] <= cx <= b[2] and b[1] <= cy <= b[3]] == [r * 3 + c]
    assert len(L.borderless_tables(grid() + grid(y=400))) == 2
    assert L.borderless_tables(grid(), existing=[(90, 40, 400, 130)]) == [] and L.borderless_tables([]) == []
    text = [(line(20 * i, *((x, x + 30) for x in range(0, 300, 35))), ["word"] * 9) for i in range(4)]
    assert L.borderless_tables(text) == []
    starts = L.column_starts(line(0, (0, 20), (25, 45), (50, 60), (120, 140)), ["a", "7", "b", "c"], 10)
    assert starts == [0.0, 120.0, 25.0]
    assert L.boundaries_from_centres([0, 100, 103], 10) == [98.0, 101.5]
    assert L.aligned_boundaries([x for x, _ in grid()], [t for _, t in grid()], 12)[1] == [0, 1, 2, 3] and L.aligned_boundaries([], [], 12) == ([], [])
    rows = [line(0, (0, 40), (100, 140)), line(20, (0, 60), (100, 120))]
    assert L.refined([80.0], rows, 10, 12) == [pytest.approx(98.2)]  # the right edges line up
    assert len(L.with_aligned_gaps([50.0], [x for x, _ in grid(cols=4, rows=4, x=0)], 12, 0.6, 10)) >= 1


def test_charts():
    y = np.array([[50, 100 + 80 * i, 80, 112 + 80 * i] for i in range(5)], float)
    x = np.array([[120 + 100 * i, 500, 150 + 100 * i, 512] for i in range(5)], float)
    assert len(L.axis_clusters(y, "y", 800, 1000)) == 1 and L.axis_clusters(y[:2], "y", 800, 1000) == [] and len(L.axis_clusters(x, "x", 800, 1000)) == 1
    irregular = y.copy()
    irregular[2, [1, 3]] += 45
    assert L.axis_clusters(irregular, "y", 800, 1000) == []
    tokens, texts = np.concatenate([y, x]), [str(i) for i in range(10)]
    ((box, method),) = L.charts(tokens, texts, [], [], 800, 1000)
    assert method == "axis" and box[0] <= 50 and box[1] <= 100 and box[2] >= 550 and box[3] >= 512
    ((box, method),) = L.charts(y, texts[:5], [], [], 800, 1000)
    assert method == "axis_y" and L.charts(y, ["a"] * 5, [], [], 800, 1000) == []
    ((box, method),) = L.charts(np.array([[100, 300, 300, 320]], float), ["word"], [], [("Figure 2", (100, 100, 300, 120))], 800, 1000)
    assert method == "title" and box[1] > 120
    assert L.axis_alone(y, 800, 1000, [(300, 100, 700, 300)])[2] == 290 and L.axis_pair(y, x - [0, 450, 0, 450], 800, 1000) is None
    assert [L.is_numeric_token(t) for t in ("-1.5", "3 psi", "a", ".", "1.2.3", "")] == [True, True, False, False, False, False]


def test_titles():
    lines = [((0, 0, 300, 12), "Company report"), ((10, 80, 200, 92), "Pump 7"), ((10, 96, 200, 108), "Measured values"), ((0, 400, 90, 412), "Figure 3 shows")]
    got = L.table_titles(lines, [(0, 115, 300, 300)])
    assert [(n, t) for n, t, _ in got] == [(1, "Pump 7\nMeasured values"), (None, "Figure 3 shows")] and got[0][2] == (10, 80, 200, 108)
    assert L.table_titles([], [(0, 0, 1, 1)]) == []


def test_cells():
    cells = [(x, y, x + 100, y + 40) for y in (0, 40) for x in (0, 100)] + [(0, 80, 200, 120), (0, 120, 70, 160), (70, 120, 200, 160)]
    assert L.row_bands(cells) == [(0, 40), (40, 80), (80, 120), (120, 160)] and L.column_bounds(cells) == [0, 70, 100, 200]
    assert L.rows_by_centre(cells) == [[0, 1], [2, 3], [4], [5, 6]]
    assert L.inner_lines(cells[:2], 0, 200, 20) == [100] and L.inner_lines(cells[4:5], 0, 200, 20) is None
    assert L.same_lines([1, 2], [2, 3], 1) and not L.same_lines([1], [1, 2], 1) and not L.same_lines(None, [], 1) and L.same_lines(None, None, 1)
    assert L.split_by_lines(cells) == [[0, 1, 2, 3, 4], [5, 6]] and L.split_by_lines([]) == []
    points = [(x, y) for x in (0, 100, 200) for y in (0, 50)]
    sides = [(0, -1, 200, 1), (0, 49, 200, 51)]
    ups = [(x - 1, 0, x + 1, 50) for x in (0, 100, 200)]
    assert L.cells_from_corners(points, sides, ups) == [(0, 0, 100, 50), (100, 0, 200, 50)] and L.cells_from_corners(points, sides, ups[:1]) == []
    assert L.corners([(0, 0), (4, 2), (100, 0)]) == [(2, 1), (100, 0)]
    assert L.ascii_table([["a", "bb"], ["1"]]) == "+-----+-----+\n| a   | bb  |\n+=====+=====+\n| 1   |     |\n+-----+-----+" and L.ascii_table([]) == ""
    assert "..." in L.ascii_table([["x" * 50]])
    drawn = L.ascii_replica([((0, 0, 100, 40), "ab"), ((100, 0, 200, 40), "c"), ((0, 40, 200, 80), "wide")], 20).split("\n")
    assert len({len(x) for x in drawn}) == 1 and drawn[1].count("|") == 3 and drawn[3].count("|") == 2 and "wide" in drawn[3] and L.ascii_replica([]) == ""


def test_repeated_cells(spark):
    cells = [(0, 0, 100, 40), (1, 1, 101, 41), (0, 0, 60, 40), (200, 0, 300, 40)]
    assert L.unique_cells(cells) == [2, 0, 3] and L.unique_cells([]) == []
    assert L.merged_in_rows([(0, 0, 100, 40), (2, 0, 98, 40), (200, 0, 300, 40), (0, 60, 9, 80)]) == [0, 2, 3] and L.merged_in_rows([]) == []
    frame = spark.createDataFrame([(1, 1, i, *map(float, c)) for i, c in enumerate(cells)], "doc_id long, page int, cell_id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.cell_id for r in L.without_repeats(frame).collect()} == {0, 3}


def test_totals(spark):
    keys = "doc_id long, page int"
    got = L.page_totals(spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], keys), spark.createDataFrame([(1, 2)], keys), spark.createDataFrame([], keys))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2, 0, 0), (1, 2, 1, 1, 0), (1, None, 3, 1, 0), (2, 1, 1, 0, 0), (2, None, 1, 0, 0)}
    cells = spark.createDataFrame([(1, 1, "a", 2), (1, 1, None, None), (1, 2, "a", 3)], keys + ", ocr_method string, n_tokens int")
    by_page = L.method_histogram(cells, ["doc_id", "page"])
    assert {tuple(r) for r in L.merged_histograms(by_page, ["doc_id"]).collect()} == {(1, "a", 2, 5), (1, "unknown", 1, 0)}
    stats = spark.createDataFrame([(1, {"p": {"x": 1, "y": None}}), (1, {"p": {"x": 2}, "q": None}), (1, None)], "doc_id long, stats map<string,map<string,int>>")
    assert {tuple(r) for r in L.merged_stats(stats, ["doc_id"]).collect()} == {(1, "p", "x", 3), (1, "p", "y", 0)}


def test_frames(spark):
    rows = [(1, 1, n, b.tolist(), t) for n, (boxes, texts) in enumerate(grid()) for b, t in zip(boxes, texts, strict=True)]
    tokens = spark.createDataFrame([(d, p, i, n, *b, t, 0.5) for i, (d, p, n, b, t) in enumerate(rows)], "doc_id long, page int, token_id int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, conf double")
    got = L.find_borderless_tables(tokens).collect()
    assert len(got) == 12 and {(r.row, r.col) for r in got} == {(r, c) for r in range(4) for c in range(3)}
    assert L.find_charts(tokens, 800.0, 1000.0).count() == 0
    assert {r.segment for r in L.split_lines(tokens).filter("line_no = 0").collect()} == {0, 1, 2} or L.split_lines(tokens).count() == 12
    assert L.page_text(tokens).first().text.split("\n")[1] == "row1 1.1 1.2"
    cells = spark.createDataFrame([(1, 1, 1, i, r, c, t) for i, (r, c, t) in enumerate([(0, 0, "a"), (0, 2, "c"), (1, 1, "x"), (1, 1, "y")])], "doc_id long, page int, table_id int, cell_id int, row int, col int, text string")
    assert [r.cells for r in L.table_matrix(cells, ["doc_id", "page", "table_id"]).orderBy("row").collect()] == [["a", "", "c"], ["", "y", ""]]
    assert L.cell_at(cells, 1, 1).first().text == "x"
    letters = spark.createDataFrame([(1, 0, 0.0, 5.0, 0.0, 10.0, "1"), (1, 0, 6.0, 9.0, 0.0, 10.0, "2"), (1, 0, 30.0, 35.0, 0.0, 10.0, "V"), (1, 1, 0.0, 5.0, 12.0, 20.0, "z")], "cell int, line_no int, x0 double, x1 double, y0 double, y1 double, text string")
    assert L.cell_text(letters, ["cell"]).first().text == "1 2 V z" and L.cell_text(letters, ["cell"], 0.3).first().text == "12 V z"
    again = spark.createDataFrame([(1, 1, 0, "better", 0.9), (1, 1, 1, "worse", 0.1)], "doc_id long, page int, token_id int, text string, conf double")
    assert [r.text for r in L.surer_tokens(tokens, again).orderBy("token_id").limit(2).collect()] == ["better", "0.1"]
    assert L.scaled(tokens, 2.0).agg(F.min("x0")).first()[0] == 200.0
    assert L.variant_matrix(spark, [1.0, 2.0], [3, 6, 11], ["keep", "cut", "thin"]).count() == 18
