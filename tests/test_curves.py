"""Curves in chunks and next rows over ranges, one key holding most of the rows."""

import random

from gaugeweave.operators import trending as T


def rows(n=4000):
    r = random.Random(1)
    out = [("hot" if r.random() < 0.9 else r.choice(["a", None]), r.randrange(1500), float(r.randrange(9))) for _ in range(n)]
    return out + [("hot", 5, float("nan")), ("a", 7, None), ("one", 3, 1.0), ("none", 1, float("inf"))]


def test_chunks_of_one_large_key(spark):
    data = rows()
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(k, o, float(o), y) for k, o, y in data], "k string, o int, x double, y double").repartition(7)
        chunks = T.curve_chunks(frame, ["k"], "x", "y", "o", 100)
        got = {(c.k, c.chunk_no): c for c in chunks.collect()}
        whole = {c.k: c for c in T.assembled(chunks, ["k"]).collect()}
        parts = T._dealt(frame.filter("k = 'hot'"), ["k"], ["o", "x", "y"])[1].count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert parts >= 4  # of one key
    for k in ("hot", "a", None, "one"):
        mine = sorted((o, y) for q, o, y in data if q == k and y is not None and y == y and abs(y) != float("inf"))
        assert list(zip(whole[k].x, whole[k].y)) == [(float(o), y) for o, y in mine] and whole[k].n_points == len(mine)
        for n in range(-(-len(mine) // 100)):
            c, part = got[k, n], mine[100 * n : 100 * n + 100]
            after = mine[100 * n + 100] if len(mine) > 100 * n + 100 else (None, None)
            assert (c.x, c.y, c.n_points) == ([float(o) for o, _ in part], [y for _, y in part], len(part)) and (c.next_x, c.next_y) == after
    assert {k for k, _ in got} == {"hot", "a", None, "one"}


def test_next_rows_across_ranges(spark):
    data = sorted({(k, o) for k, o, _ in rows()}, key=repr)
    got = {(r.k, r.o): r._next and r._next.o for r in T.followed(spark.createDataFrame(data, "k string, o int").repartition(5), ["k"], ["o"]).collect()}
    for k in {k for k, _ in data}:
        mine = sorted(o for q, o in data if q == k)
        assert [got[k, o] for o in mine] == [*mine[1:], None]
    assert len(got) == len(data)
