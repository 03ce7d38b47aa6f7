"""Vectors, mixing, WARC, the pipeline, and queries against their SQL."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gaugeweave.llm import ann, mixing, pieces, queries, storage, topk, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, spark, sf, duck):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLE[name])


def test_all_registered(spark, sf):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=130, d=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[7] = x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(100000, None, 0), (100001, [], 0), (100020, [0.0] * d, 0), (100040, [float("nan")] + [1.0] * (d - 1), 0), (100060, [None] + [1.0] * (d - 1), 0), (100080, [float("inf")] * d, 0), (100100, [1.0] * (d + 1), 0), (None, [1.0] * d, 0), (20, x[3].tolist(), 0)]
    return spark.createDataFrame(rows + odd, VECTORS), [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows] + [(20, x[3].astype(np.float32).astype(float))], d


def brute_nearest(rows, k=20):
    """(query, rank, id, score) over (id, vector) rows: repeated ids are candidates each time and one query, of the least vector."""
    out = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        v = min((v for i, v in rows if i == q), key=lambda v: v.tolist())
        ranked = sorted((-(v * w).sum(), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return out


def usable(frame):
    return [(r.vec_id, np.array(r.embedding, np.float32).astype(float)) for r in frame.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]


def other_lengths(spark, d):
    """Vectors of a second length, which have neighbours of their own."""
    x = np.random.default_rng(9).normal(size=(30, d + 1))
    return spark.createDataFrame([(200_000 + i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)


@pytest.mark.parametrize("rows_in_block", [1 << 15, 30])
def test_exact_top_k(spark, rows_in_block):
    frame, _, d = vectors(spark)
    frame = frame.unionByName(other_lengths(spark, d)).withColumns({"block": F.lit("x"), "id": F.lit(1), "v": F.lit(2)})
    got = [tuple(r) for r in topk.search(frame, rows_in_block=rows_in_block).collect()]
    want = brute_nearest([(i, np.floor(64 * v).astype(int)) for i, v in usable(frame)])
    assert sorted(got) == sorted(want) and {q for q, *_ in got} >= {0, 20, 100000 + 20, 200_000}
    assert topk.search(frame.limit(0)).count() == 0


def test_top_k_with_strong_components(spark):
    r = np.random.default_rng(3)
    x = np.where(r.random((500, 12)) < 0.15, r.integers(1, 200, (500, 12)), 0)
    index = topk.Index(x)
    for i in range(0, 500, 25):
        at = index.members(x[i], np.arange(500) == i, 5)
        s = x @ x[i]
        s[i] = -1
        assert set(np.lexsort((np.arange(500), -s))[:5]) <= set(at) | set(np.flatnonzero(s == np.sort(s)[-5]))


def test_nearest_neighbours(spark):
    frame, _, d = vectors(spark, 2000, 32)
    frame = frame.unionByName(other_lengths(spark, d)).withColumns({"block": F.lit("x"), "id": F.lit(1), "v": F.lit(2)})
    got = [tuple(r) for r in ann.search(frame, sample_rows=500, rows_in_block=700).collect()]
    rows = [(i, v) for i, v in usable(frame) if (v != 0).any()]
    want = brute_nearest(rows)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len({(q, i) for q, _, i, _ in want})
    scores = {}
    for q, rank, _, s in sorted(got):
        scores.setdefault(q, []).append(s)
        assert rank == len(scores[q])
    assert all(s == sorted(s, reverse=True) for s in scores.values())
    # rows of a length without codes are ranked exactly
    assert sorted(x for x in got if x[0] >= 200_000) == [(q, n, i, pytest.approx(s)) for q, n, i, s in want if q >= 200_000]
    few = frame.filter("vec_id < 3")
    assert [(r.query_id, r["rank"]) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.search(frame.limit(0)).count() == 0


def test_index_returns_every_code_in_the_radius():
    bits = np.random.default_rng(2).integers(0, 256, (3000, 8), dtype=np.uint8)
    index = ann.Index(bits)
    for radius in (0, 5, 16, 23, 64):
        want = np.flatnonzero(ann.POPCOUNT[bits ^ bits[4]].sum(1) <= radius)
        assert (index.within(bits[4], radius) == want).all()


# mixing
def mixed(spark, spec=mixing.Mixing()):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 3 else f"s{i % 9}") for i in range(600)] + [(700, None, "big"), (701, "", None), (702, "x y", None), (None, "a b c", "big"), (5, "w w", "big")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d, mixing.mixed_documents(d, spec).collect()


def test_mixing_weights(spark):
    d, got = mixed(spark, mixing.Mixing(entropy_ratio=0.9, max_repeat=3.0, block_tokens=100))
    a, tokens, used = got[0].exponent, Counter(), Counter()
    for r in d.collect():
        tokens[r.source or ""] += len((r.text or "").split())
    for r in got:
        used[r.source or ""] += len((r.text or "").split())
    assert all(len({x.pass_no for x in got if x.doc_id == i}) >= 1 for i in range(600))
    shares = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    top = max(shares.values())
    assert max((top / p) ** (1 - a) for p in shares.values()) <= 3.0 + 1e-6
    for s, n in tokens.items():
        want = n * (top / shares[s]) ** (1 - a)
        assert want - 1e-6 <= used[s] <= want + 12


def test_mixing_keeps_columns_of_any_name(spark):
    d, _ = mixed(spark)
    clash = {c: F.lit(f"my {c}") for c in ("passes", "n_blocks", "cut_key", "weight", "uses", "exponent", "last_block", "block", "pass_no", "_source", "_key", "_row", "block_rank")}
    named = d.withColumns(clash)
    plain = mixing.mixed_documents(d).select("doc_id", "text", "pass_no").collect()
    got = mixing.mixed_documents(named)
    assert sorted(map(repr, plain)) == sorted(map(repr, got.select("doc_id", "text", "pass_no").collect()))
    assert got.first()["cut_key"] == "my cut_key" and isinstance(got.first()["weight"], float)
    bare = mixing.mixed_documents(named, marks=())
    assert bare.columns == named.columns and bare.count() == len(plain) and bare.first()["weight"] == "my weight"
    assert mixing.mixing_plan(named).count() == len(plain)


def test_mixing_budget_and_limits(spark):
    d, got = mixed(spark, mixing.Mixing(budget=500, block_tokens=50))
    assert 480 <= sum(len((r.text or "").split()) for r in got) <= 600
    assert mixed(spark, mixing.Mixing(max_repeat=1.0))[1][0].exponent == pytest.approx(1, abs=1e-5)
    assert mixing.mixing_plan(d.limit(0)).count() == 0
    one = mixing.mixing_plan(d.filter("source = 'big'"))
    assert {r.pass_no for r in one.collect()} == {1}
    assert mixing.mixing_plan(d.select("doc_id", F.lit(None).cast("string").alias("text"), "source")).count() == d.count()


def test_mixing_equals_sql_on_uneven_sources(spark, duck):
    d, _ = mixed(spark)
    d = d.filter("doc_id is not null")
    duck.sql("CREATE OR REPLACE TABLE uneven AS SELECT * FROM (SELECT unnest(?, recursive := true))", params=[[r.asDict() for r in d.collect()]])
    spec = mixing.Mixing(block_tokens=64)
    same_rows(mixing.mixing_plan(d, spec), duck, mixing.oracle_sql(spec, "uneven"))


# WARC
def test_warc_round_trip(spark):
    rows = [(i, f"u{i}", ("x%d" % (i % 7)) * i if i % 3 else None) for i in range(60)] + [(None, None, "zz"), (59, "d", "q"), (59, "d\r\n", "q"), (100, "u", "é" * 40_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    by = {}
    for p, _, h in rows:
        by.setdefault(h or "", []).append(p)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = max((x for x in by[h or ""] if x is not None), default=None)
        again = top is not None and p != top
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted(map(repr, (tuple(r) for r in warc.round_trip(d).collect()))) == sorted(map(repr, want))
    assert warc.round_trip(d.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(d, min_bytes=1 << 20).collect()} == {"response"}


@pytest.mark.parametrize("split", [97, 131, 700, 100_000])
def test_warc_ranges_and_false_magic(spark, tmp_path, split):
    def member(content):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(content) + z.flush()

    payload = lambda i: (warc.MAGIC * 3 + b"payload%d" % i + warc.MAGIC) * (i % 4)
    (tmp_path / "a.warc").write_bytes(b"".join(member(warc.record(i, "u", payload(i), "D", None, False)) for i in range(40)) + warc.EMPTY_MEMBER)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    try:
        for k, v in zip(old, (str(split), "1", "1"), strict=True):
            spark.conf.set(k, v)
        got = sorted((r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, f"file://{tmp_path}").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == [(i, payload(i)) for i in range(40)]


def test_archive_within_an_archive(spark, tmp_path):
    def member(content, level=0):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(content) + z.flush()

    inner = b"".join(member(warc.record(1000 + i, "in", b"inner %d" % i, "D", None, False), 9) for i in range(30))
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    outer = [warc.record(i, "u", inner if i % 5 == 2 else b"plain %d" % i, "D", None, False) for i in range(12)]
    for name in ("a.warc", "b.warc.gz"):  # names that end in .gz are split as well
        (tmp_path / name).write_bytes(member(info) + b"".join(map(member, outer)))
    (tmp_path / "c.warc").write_bytes(b"junk" + member(outer[0]) + b"more junk" + warc.MAGIC + b"and more" + member(outer[1]) + member(outer[3])[:-9])
    (tmp_path / "not.warc").write_bytes(b"no archive at all " * 50)
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = warc.read_archives(spark, f"file://{tmp_path}").select("record_type", "page_id", "payload").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    want = [("response", i, inner if i % 5 == 2 else b"plain %d" % i) for i in range(12)] * 2 + [("warcinfo", None, b"")] * 2 + [("response", i, b"plain %d" % i) for i in (0, 1)]
    assert sorted((r.record_type, r.page_id or 0, bytes(r.payload)) for r in got) == sorted((t, i or 0, p) for t, i, p in want)


def test_large_members_end_in_zero():
    big = warc._gzip(b"\xff" * 10, 1)
    assert big[-1] == 0 and zlib.decompress(warc.EMPTY_MEMBER, 31) == b""


# storage and pipeline
def test_sized_join_has_both_ways(spark):
    a, b = spark.range(100), storage.durable(spark.range(50))
    for limit in (10, 1000):
        assert storage.sized_join(a, b, "id", "left_anti", limit).count() == 50


def test_near_duplicates_of_repeated_ids_are_decided_by_row(spark, sf):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    near = lambda w: text(w) + " more"
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, near("b")), (8, text("c")), (8, text("d")), (9, text("c")), (10, text("d")), (11, text("e")), (11, near("e")), (12, text("f")), (12, text("f")), (13, None), (13, "!!!"), (13, text("g")), (13, None), (None, text("h")), (14, text("i"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates_stage(spark, docs, sf).collect()]
    eleven = [t for i, t in got if i == 11]
    assert len(eleven) == 1 and eleven[0] in (text("e"), near("e"))
    want = [(1, text("a")), (5, text("b")), (8, text("c")), (8, text("d")), (12, text("f")), (13, None), (13, "!!!"), (13, text("g")), (None, text("h")), (14, text("i"))]
    assert sorted(map(repr, got)) == sorted(map(repr, [*want, (11, eleven[0])]))


def test_the_encoding_stage_keeps_one_python_worker_a_task(spark, sf):
    """texts passed two Python workers of each task, with exploded rows between them; the check stopped it at 3,001 MB."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = corpus_pipeline.encoding_stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "Join" not in plan


def test_pipeline_stages_on_odd_input(spark, sf):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (2, None), (None, None), (3, ""), (4, "!!!"), (5, "x" * 200_000), (None, text("a")), (6, "mail a.b@c.org"), (7, text("g") + " more"), (8, text("g"))]
    clash = {c: F.lit(c) for c in ("passes", "n_blocks", "cut_key", "weight", "pii_kinds", "_hash", "_row", "_again", "_id", "class_id", "node", "block", "score", "predicted")}
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", "s" if i else None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert stages[0](spark, docs, sf).columns == docs.columns
    kept = stages[1](spark, docs, sf)
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert kept.columns == docs.columns and ids == sorted([1, 1, 2, None, 3, 4, 5, None, 6, 7], key=repr)
    private = stages[2](spark, docs, sf)
    assert private.columns == docs.columns and {r["pii_kinds"] for r in private.collect()} == {"pii_kinds"}
    assert not private.filter("text like '%a.b@c%'").count() and private.count() == docs.count()
    mixed_ = stages[3](spark, docs, sf)
    assert mixed_.columns == docs.columns and {r["weight"] for r in mixed_.collect()} == {"weight"} and mixed_.exceptAll(docs).filter("doc_id = 2").isEmpty()
    coded = {(r.doc_id, r.n_tokens) for r in stages[4](spark, docs, sf).collect()}
    assert (2, 0) in coded and (3, 0) in coded
    empty = docs.limit(0)
    for stage in stages:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and (stage is stages[-1] or out.columns == docs.columns)


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == names
        if k < 2:
            assert after.exceptAll(before).isEmpty() and after.count() < before.count()
        if k == 2:
            assert after.count() == before.count() and not after.filter("text rlike '@mail[0-9]'").count()
        if k == 3:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        if k == 4:
            sp = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == sp.encode(texts[r.doc_id]) and r.round_trip for r in after.collect())
        before = after
    assert corpus_pipeline.run(spark, sf).count() == before.count()
