"""Strokes, rules, valleys and grids of pictures against slow readings; tokens inside small PDF files."""

import random
import zlib

import numpy as np
import pytest

from gaugeweave.operators import layout, pixels
from gaugeweave.sources import pdf


def slow_open(ink):
    """Closing by 3 by 3 and opening by a wide line, pixel by pixel; pixels outside of the picture don't count."""
    h, w = ink.shape

    def each(x, test, ys, xs):
        return np.array([[test(x[max(0, i + ys[0]) : i + ys[1] + 1, max(0, j + xs[0]) : j + xs[1] + 1]) for j in range(w)] for i in range(h)])

    n = max(int(w * 0.35), 40)
    a = n // 2
    x = each(each(ink, np.any, (-1, 1), (-1, 1)), np.all, (-1, 1), (-1, 1))
    return each(each(x, np.all, (0, 0), (-a, n - 1 - a)), np.any, (0, 0), (-a, n - 1 - a))


def test_strokes_equal_a_slow_reading():
    r = np.random.default_rng(1)
    for seed in range(4):
        ink = r.random((24, 90)) < 0.15
        ink[r.integers(24), :] = True
        ink[r.integers(24), 20 : 20 + r.integers(60)] = True
        assert (pixels.long_strokes(ink) == slow_open(ink)).all(), seed


def test_connected_parts():
    r = np.random.default_rng(2)
    for _ in range(30):
        x = r.random((12, 14)) < 0.4
        seen, want = set(), []
        for at in zip(*np.nonzero(x)):
            if at in seen:
                continue
            todo, part = [at], []
            seen.add(at)
            while todo:
                i, j = todo.pop()
                part.append((i, j))
                for p in range(i - 1, i + 2):
                    for q in range(j - 1, j + 2):
                        if 0 <= p < 12 and 0 <= q < 14 and x[p, q] and (p, q) not in seen:
                            seen.add((p, q))
                            todo.append((p, q))
            ys, xs = [p for p, _ in part], [q for _, q in part]
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert sorted(pixels.connected(x)) == sorted(map(lambda b: tuple(map(int, b)), want))


def test_threshold_and_valleys():
    grey = np.full((20, 60), 200, np.uint8)
    grey[5:15, 5:20] = grey[5:15, 40:55] = 30
    assert (pixels.dark(grey) == (grey == 30)).all() and not pixels.dark(np.full((9, 9), 255, np.uint8)).any()
    found = pixels.valleys(pixels.dark(grey), 6.0)
    assert len(found) == 3 and found[0] == 0 and 20 < found[1] < 40 and found[2] > 54
    assert pixels.valleys(pixels.dark(grey), 60.0) == []


def test_pages_to_cells(spark):
    grey = np.full((60, 120), 255, np.uint8)
    for y in (0, 20, 21, 40):
        grey[y, :] = 0
    grey[26:34, 10:50] = 0
    rows = [(1, 120, 60, grey.tobytes()), (2, 120, 60, b"x"), (3, 120, 60, None), (4, 120, 60, bytes([255]) * 7200), (5, None, 60, b"")]
    pictures = spark.createDataFrame(rows, "page int, width int, height int, pixels binary")
    regions = spark.createDataFrame([(p, r, *b) for p in range(1, 6) for r, b in (("all", (0.0, 0.0, 120.0, 60.0)), ("low", (0.0, 30.0, 500.0, 900.0)), ("thin", (0.0, 0.0, 120.0, 5.0)), (None, (0.0, 0.0, 9.0, 9.0)))], "page int, region string, x0 double, y0 double, x1 double, y1 double")
    found = {(r.page, r.region): r.ys for r in pixels.rules(pictures, regions, ["page"]).collect()}
    assert found == {(1, "all"): [0.5, 21.0, 40.5], (1, "low"): [40.5]}
    rules = pixels.rules(pictures, regions, ["page"])
    edges = {r.region: r.edges for r in pixels.ruled_rows(rules, ["page"]).collect()}
    assert edges["all"] == layout.rule_edges([0.5, 21.0, 40.5], 0.0, 60.0, 2) == [0.0, 21.0, 40.5, 60.0]
    assert edges["low"] == layout.rule_edges([40.5], 30.0, 900.0, 2)
    marks = pixels.white_valleys(pictures, regions, ["page"]).filter("region = 'all' and page = 1")
    cells = pixels.grid(pixels.ruled_rows(rules, ["page"]).filter("region = 'all'"), marks, ["page"]).collect()
    xs = layout.inside_positions([r.x for r in marks.collect()], 0.0, 120.0, 10.0)
    assert len(cells) == 3 * (len(xs) + 1) and {(c.y0, c.y1) for c in cells} == {(0.0, 21.0), (21.0, 40.5), (40.5, 60.0)}


def test_snapping_and_grids_equal_the_loops(spark):
    r = random.Random(3)
    own = [(k, "a", float(r.randrange(200)) / 2) for k in range(5) for _ in range(12)]
    to = [(k, "a", float(r.randrange(200)) / 2) for k in range(4) for _ in range(6)]
    kind = "page int, region string, x double"
    got = sorted((x.page, x.x) for x in pixels.snapped_boundaries(spark.createDataFrame(own, kind), spark.createDataFrame(to, kind), ["page"], 4.0).collect())
    assert got == sorted((k, v) for k in range(5) for v in layout.snapped([x for p, _, x in own if p == k], [x for p, _, x in to if p == k], 4.0))
    rows = spark.createDataFrame([(k, "a", 0.0, 0.0, 100.0, 10.0, [0.0, 5.0, 10.0]) for k in range(5)], "page int, region string, x0 double, y0 double, x1 double, y1 double, edges array<double>")
    cells = pixels.grid(rows, spark.createDataFrame(own, kind), ["page"]).collect()
    for k in range(5):
        want = [0.0, *layout.inside_positions([x for p, _, x in own if p == k], 0.0, 100.0, 10.0), 100.0]
        assert sorted({c.x0 for c in cells if c.page == k}) == want[:-1] and sorted({c.x1 for c in cells if c.page == k}) == want[1:]


def written(objects, trailer, xref=True):
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    if xref:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in at.items())
    return bytes(out + b"trailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF" % (start if xref else 999_999))


def stream(body, more=b"", packed=False):
    raw = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n" % (len(raw), b"/Filter /FlateDecode" if packed else b"", more) + raw + b"\nendstream"


ROOT = b"<< /Type /Catalog /Pages 3 0 R >>"
LINKED = b"<< /Type /Catalog /Metadata 4 0 R >>"
TRAILER = b"<< /Size 9 /Root 1 0 R /Info 2 0 R >>"


def with_object_stream(info):
    """Version 1.5: the information dictionary in an object stream, the table a stream with a predictor."""
    out, at = bytearray(b"%PDF-1.5\n"), {}
    packed = b"2 0 " + info
    for n, body in ((1, ROOT), (5, stream(packed, b"/Type /ObjStm /N 1 /First 4", True))):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    rows = [bytes([0, 0, 0, 0]), bytes([1, *at[1].to_bytes(2, "big"), 0]), bytes([2, 0, 5, 0]), bytes(4), bytes(4), bytes([1, *at[5].to_bytes(2, "big"), 0])]
    coded, above = b"", bytes(4)
    for row in rows:
        coded += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above))
        above = row
    start = len(out)
    out += b"6 0 obj\n" + stream(coded, b"/Type /XRef /W [1 2 1] /Size 6 /Root 1 0 R /Info 2 0 R /DecodeParms << /Predictor 12 /Columns 4 >>", True) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


CASES = {
    "key": (written({1: ROOT, 2: b"<< /TagUUID (x) >>"}, TRAILER), ("info", None)),
    "value": (written({1: ROOT, 2: b"<< /Title (made by \\(a\\) TAG\\0601 \\\nx) /K [1 2.5 true null <</A/B>>] >>"}, TRAILER), ("info", None)),
    "hex and sixteen bits": (written({1: ROOT, 2: b"<< /Title <FEFF" + "my tag".encode("utf-16-be").hex().encode() + b"> >>"}, TRAILER), ("info", None)),
    "reference": (written({1: ROOT, 2: b"<< /Title 7 0 R >>", 7: b"(tag)"}, TRAILER), ("info", None)),
    "xmp": (written({1: LINKED, 2: b"<< /Title (x) >>", 4: stream(b"<x:xmpmeta>Tag</x:xmpmeta>")}, TRAILER), ("xmp", None)),
    "packed xmp without info": (written({1: LINKED, 4: stream(b"<x>taG</x>", b"", True)}, b"<< /Root 1 0 R >>"), ("xmp", None)),
    "object stream": (with_object_stream(b"<< /Producer (tag 1) >>"), ("info", None)),
    "none": (written({1: LINKED, 2: b"<< /Title (ta g) >>", 4: stream(b"<x/>")}, TRAILER), (None, None)),
    "the word elsewhere": (written({1: ROOT, 2: b"<< /Title (x) >>", 8: stream(b"tag tag")}, TRAILER), (None, None)),
    "broken table": (written({1: ROOT, 2: b"<< /Subject (tag) >>"}, TRAILER, xref=False), ("info", None)),
    "cut": (written({1: ROOT, 2: b"<< /Subject (tag) >>"}, TRAILER)[:60], (None, None)),
    "cut early": (b"%PDF-1.4\n1 0 obj\n<< /Ty", (None, "damaged")),
    "encrypted": (written({1: ROOT, 2: b"<< /Subject (tag) >>", 7: b"<< /Filter /Standard >>"}, b"<< /Root 1 0 R /Info 2 0 R /Encrypt 7 0 R >>"), (None, "encrypted")),
    "text": (b"tag", (None, "not a PDF")),
    "empty": (b"", (None, "empty")),
    "null": (None, (None, "empty")),
    "loop": (written({1: b"1 0 R", 2: b"2 0 R"}, TRAILER), None),
}


@pytest.mark.parametrize("name", CASES)
def test_token(name):
    got = pdf.token_in(CASES[name][0], "Tag")
    assert CASES[name][1] in (got, None)


def test_newer_entries_hold():
    old = written({1: ROOT, 2: b"<< /Title (tag) >>"}, TRAILER)
    at = len(old)
    new = old + b"\n2 0 obj\n<< /Title (clean) >>\nendobj\nxref\n2 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Info 2 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at + 1, old.rindex(b"xref\n0 1"), at + 1 + len(b"2 0 obj\n<< /Title (clean) >>\nendobj\n"))
    assert pdf.token_in(old, "tag") == ("info", None) and pdf.token_in(new, "tag") == (None, None)


def test_any_bytes_are_a_row():
    r = random.Random(4)
    whole = [c for c, _ in CASES.values() if c]
    for _ in range(400):
        c = bytearray(r.choice(whole))
        for _ in range(r.randrange(1, 6)):
            c[r.randrange(len(c) + 1) : r.randrange(len(c) + 1)] = bytes(r.randrange(256) for _ in range(r.randrange(4)))
        where, reason = pdf.token_in(bytes(c), "tag")
        assert where in (None, "info", "xmp")


def test_files_as_rows(spark, tmp_path):
    for n, (content, _) in CASES.items():
        if content is not None:
            (tmp_path / f"{n}.PDF").write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"tag")
    got = {r.path.rsplit("/", 1)[-1].replace("%20", " ").removesuffix(".PDF"): (r.found_in, r.reason, r.has_token) for r in pdf.read_tokens(spark, f"file://{tmp_path}", "tag").collect()}
    assert {n: g[:2] for n, g in got.items() if CASES[n][1]} == {n: x for n, (c, x) in CASES.items() if c and x}
    assert all(g[2] == (g[0] is not None) for g in got.values())


def test_regions_in_the_picture_row_and_one_look(spark):
    """Regions as a column need no join of pictures, and one look finds what two find."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    rows = [(i, 90, 40, bytearray(np.where(r.random((40, 90)) < 0.03, 0, 255).astype(np.uint8).tobytes())) for i in range(6)] + [(7, 90, 40, None)]
    for _, _, _, p in rows[:5]:
        p[90 * 20 : 90 * 21] = bytes(90)
    pages = spark.createDataFrame(rows, "page long, width int, height int, pixels binary")
    regions = pages.select("page", F.lit("a").alias("region"), *(F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 90), ("y1", 40), ("text_height", 8))))
    inside = pages.join(regions.groupBy("page").agg(F.collect_list(F.struct(*regions.columns[1:])).alias("regions")), "page")
    inside = spark.createDataFrame(inside.collect(), inside.schema)
    plain = lambda df: sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))
    strokes, valleys = pixels.looked_at(inside, None, ["page"])
    assert plain(strokes) == plain(pixels.strokes(pages, regions, ["page"])) == plain(pixels.strokes(inside, None, ["page"])) and not strokes.isEmpty()
    assert plain(valleys) == plain(pixels.white_valleys(pages, regions, ["page"])) == plain(pixels.white_valleys(inside, None, ["page"])) and not valleys.isEmpty()
    plan = pixels.rules(inside, None, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
