"""Cases that earlier forms of the operators got wrong: half digests, large components, joins that shuffle, null ids."""

import functools
import random

import numpy as np
import pytest
from test_table_ops import VECTORS
from test_text_ops import docs

from gaugeweave import shared
from gaugeweave.llm import langid, nearjoin, quality, topk, warc


def test_sets_that_share_half_a_digest(spark, monkeypatch):
    whole = nearjoin.digests

    def half(sets):
        one, two = whole(sets)
        return np.zeros_like(one), two

    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [*base, *(t + " more" for t in base[:3]), base[0], None, "", "x"]
    rows = lambda d: sorted((str(x.doc_id), x.class_id, x.n_links, x.n_copies) for x in nearjoin.near_classes(d).collect())
    want = rows(docs(spark, texts))
    assert [w[2] for w in want].count(1) == 7  # three pairs, one of them with a copy
    monkeypatch.setattr(nearjoin, "digests", half)
    assert rows(docs(spark, texts)) == want
    nameless = docs(spark, texts).selectExpr("cast(null as long) as doc_id", "text")
    got = sorted((x.n_links, x.n_copies) for x in nearjoin.near_classes(nameless).collect())
    assert got == sorted((w[2], w[3]) for w in want)


@pytest.mark.parametrize("limit", [0, 3])
def test_near_join_behind_a_bitmap(spark, monkeypatch, limit):
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(40)) for _ in range(20)]
    d = docs(spark, [*base, *(t + " end" for t in base[:9])])
    rows = lambda: sorted(map(tuple, nearjoin.near_classes(d).collect()))
    want = rows()
    monkeypatch.setattr(nearjoin, "sized_join", functools.partial(shared.sized_join, limit=limit))
    assert rows() == want and sum(w[2] for w in want) == 18


def _vectors(spark, size, seed=3, n=60, d=12):
    x = np.random.default_rng(seed).integers(-size, size, (n, d))
    return spark.createDataFrame([(i, [float(v) / 64 for v in row], 0) for i, row in enumerate(x.tolist())], VECTORS.replace("array<float>", "array<double>")), x.tolist()


@pytest.mark.parametrize("bits", [24, 28, 29])
def test_large_components_are_exact(spark, bits):
    frame, x = _vectors(spark, 1 << bits)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(frame, rows_in_block=25).collect()}
    for q in range(0, 60, 20):
        ranked = sorted((-sum(a * b for a, b in zip(x[q], y)), i) for i, y in enumerate(x) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -s) for s, i in ranked]


def test_a_score_that_is_no_long_raises(spark):
    frame, _ = _vectors(spark, 1 << 40)
    with pytest.raises(Exception, match="OverflowError"):
        topk.search(frame).collect()


def test_misled_files_are_read_in_order_when_the_join_shuffles(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "".join(random.Random(i).choice("abcdef<>\n") for _ in range(4000))) for i in range(40)], "page_id long, url string, html string")
    inner = spark.read.format("binaryFile").load(warc.write_archives(pages.limit(3), f"file://{tmp_path}/in", 0) + "/*").select("content").collect()
    content = b"".join(bytes(r.content) for r in inner)
    import gzip

    def record(n, body):
        return gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body)) + body + b"\r\n\r\n", 0)

    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.warc.gz").write_bytes(b"".join(record(n, content + b"\x1f\x8b" * 9 + bytes(n)) for n in range(30)))
    read = lambda: sorted((r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, f"file://{tmp_path}/out").collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        want = read()
        monkeypatch.setattr(warc, "sized_join", functools.partial(shared.sized_join, limit=0))
        assert read() == want and len(want) >= 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rows_without_an_id_are_not_held_out(spark):
    d = docs(spark, ["the cat sat on the mat", "le chat est la", None]).selectExpr("cast(nullif(doc_id, 0) as long) as doc_id", "text", "lang", "source", "n_chars")
    assert {r.doc_id: r.held_out for r in langid.language_predictions(d).collect()}[None] is False
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.held_out for r in quality.quality_scores(d, labels).collect()}[None] is False
