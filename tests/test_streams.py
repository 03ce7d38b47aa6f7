"""State of streamed scans: parts that a batch doesn't touch stay, restarts repeat nothing, whole listings give all states."""

import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import cache, incremental
from gaugeweave.streaming import scans


def listing(spark, folder, n, rows, schema="path string, fingerprint string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{n:03d}")


def source(spark, folder, schema="path string, fingerprint string"):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def run(query):
    assert query.awaitTermination(120)
    if query.exception():
        raise query.exception()


def test_untouched_parts_are_shared(spark, tmp_path):
    at, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    listing(spark, at, 0, [(f"p{i}", "f") for i in range(300)])
    run(scans.merge_scans(spark, source(spark, at), state, ck))
    before = {p for _, _, p in cache.manifest(spark, state)[1]}
    listing(spark, at, 1, [("p7", "g"), ("new", "h"), ("new", "a")])
    run(scans.merge_scans(spark, source(spark, at), state, ck))
    version, paths = cache.manifest(spark, state)
    assert version == 2 and len(before & {p for _, _, p in paths}) >= len(before) - 2
    got = {r.path: r.fingerprint for r in scans.state(spark, state).collect()}
    assert got == {f"p{i}": "f" for i in range(300)} | {"p7": "g", "new": "h"}
    assert {r.path for r in spark.read.parquet(*[p for p in before]).collect()} == {f"p{i}" for i in range(300)}  # the version before stays readable


def test_a_failed_batch_and_a_restart(spark, tmp_path, monkeypatch):
    at, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    listing(spark, at, 0, [("a", "1"), ("b", "1")])
    run(scans.merge_scans(spark, source(spark, at), state, ck))
    listing(spark, at, 1, [("a", "2")])
    commit = cache._commit
    monkeypatch.setattr(cache, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("disk full")))
    with pytest.raises(Exception, match="disk full"):
        run(scans.merge_scans(spark, source(spark, at), state, ck))
    assert {r.path: r.fingerprint for r in scans.state(spark, state).collect()} == {"a": "1", "b": "1"}
    # committed, but the stream stops before it has noted so: the batch comes again and changes nothing
    monkeypatch.setattr(cache, "_commit", lambda *a: (commit(*a), (_ for _ in ()).throw(RuntimeError("lost")))[0])
    with pytest.raises(Exception, match="lost"):
        run(scans.merge_scans(spark, source(spark, at), state, ck))
    monkeypatch.setattr(cache, "_commit", commit)
    run(scans.merge_scans(spark, source(spark, at), state, ck))
    assert cache.manifest(spark, state)[0] == 2 and {r.path: r.fingerprint for r in scans.state(spark, state).collect()} == {"a": "2", "b": "1"}
    assert [x[:2] for x in cache.prune(spark, state, keep=1)] == ["b1"] and scans.state(spark, state).count() == 2


FILES = "rel_path string, size_bytes long, mtime_ns long, has_token boolean, token_ok boolean, artifacts_ok boolean, scan_ns long"


def test_whole_listings_give_all_states(spark, tmp_path):
    at, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    row = lambda p, m, t, token=False, ok=False, art=True, size=1: (p, size, m, token, ok, art, t)
    lists = [
        [row("keep", 1, 10), row("change", 2, 10), row("move", 3, 10, True, True, size=7), row("gone", 4, 10), row("token", 5, 10, True, True)],
        [row("keep", 1, 20), row("change", 12, 20), row("moved", 3, 20, size=7), row("token", 5, 20, True, False), row("bare", 6, 20, art=False)],
    ]
    want = spark.createDataFrame([], incremental.SCAN)
    for n, rows in enumerate(lists):
        listing(spark, at, n, rows, FILES)
        run(scans.scan_listings(spark, source(spark, at, FILES), state, ck))
        last = want.agg(F.max("last_seen_epoch_ns")).first()[0] or 0
        want = spark.createDataFrame(incremental.scan(want.drop("reason"), spark.createDataFrame(rows, FILES).drop("scan_ns"), rows[0][-1], last).collect(), incremental.SCAN + ", reason string")
        assert sorted(map(repr, scans.state(spark, state, incremental.SCAN + ", reason string").select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    got = {r.rel_path: r.reason for r in want.collect()}
    assert got["moved"].startswith("moved") and got["token"] == "metadata_missing_artifacts" and "gone" in got and "move" not in got and {got["change"], got["keep"]} <= {"pending", "changed", "never_processed"}
