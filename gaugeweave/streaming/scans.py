"""Streaming forms: incremental scans of a folder merged into a state table, and windowed metrics with late data bounded.

The state is kept in parts by a hash of the path, under a manifest for each micro-batch (:mod:`gaugeweave.operators.cache`): a batch writes only the parts that its paths are in, the others are
shared with the version before, and a batch that fails or runs again leaves or gives the same state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeweave.operators import cache, incremental

PARTS = 64
STATE = "path string, fingerprint string, processed boolean"


def windowed_metrics(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean, range of each window and key; rows later than ``late`` are dropped by the watermark, which bounds the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def state(spark: SparkSession, folder: str, schema: str = STATE, parts: set[int] | None = None) -> DataFrame:
    """The newest state, or some parts of it; no rows before the first batch."""
    _, paths = cache.manifest(spark, folder)
    wanted = [p for _, part, p in paths if parts is None or part in parts]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def _committed(spark: SparkSession, folder: str, n: int, rows: DataFrame, key: str, schema: str, touched: set[int] | None) -> None:
    """Version n + 1: ``rows`` are the touched parts (all, if None), the others are those of the version before."""
    _, paths = cache.manifest(spark, folder)
    base = f"{folder}/b{n}-{uuid.uuid4().hex}"
    rows.withColumn("part", _part(key)).repartition("part").write.partitionBy("part").parquet(base)
    kept = [] if touched is None else [p for p in paths if p[1] not in touched]
    found = touched if touched is not None else range(PARTS)
    try:
        found = {r.part for r in spark.read.schema(schema + ", part int").parquet(base).select("part").distinct().collect()}  # at most PARTS
    except cache.AnalysisException:  # no rows are left
        found = set()
    cache._commit(spark, folder, n + 1, [*kept, *(("state", part, f"{base}/part={part}") for part in sorted(found))] or [("none", -1, base)])


def _each_batch(spark: SparkSession, listings: DataFrame, folder: str, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def once(batch: DataFrame, n: int) -> None:
        if cache.manifest(spark, folder)[0] <= n:  # a batch that was committed before a restart is not merged again
            merge(batch, n)

    return listings.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_scans(spark: SparkSession, listings: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (path, fingerprint) rows is merged into the state; what it reads and writes are the parts that its paths are in."""

    def merge(batch: DataFrame, n: int) -> None:
        fresh = batch.groupBy("path").agg(F.max("fingerprint").alias("fingerprint"))
        touched = {r.p for r in fresh.select(_part("path").alias("p")).distinct().collect()}
        old = state(spark, state_path, STATE, touched)
        kept = old.join(fresh.select("path"), "path", "left_anti").select("path", "fingerprint", "processed")
        _committed(spark, state_path, n, incremental.merge(old.join(fresh.select("path"), "path", "left_semi"), fresh).unionByName(kept), "path", STATE, touched)

    return _each_batch(spark, listings, state_path, checkpoint, merge)


def scan_listings(spark: SparkSession, listings: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is one whole listing of a repository (as :func:`gaugeweave.operators.incremental.scan` takes it, and scan_ns, its time): all states of a scan, moves and vanished files among
    them, follow from the state that the listing before left. Its work is in proportion to the listing, which is as long as the state.
    """
    schema = incremental.SCAN + ", reason string"

    def merge(batch: DataFrame, n: int) -> None:
        at = batch.agg(F.max("scan_ns").alias("t")).first().t
        if at is None:
            return
        old = state(spark, state_path, schema)
        last = old.agg(F.max("last_seen_epoch_ns").alias("t")).first().t or 0
        _committed(spark, state_path, n, incremental.scan(old.drop("reason"), batch.drop("scan_ns"), at, last), "rel_path", schema, None)

    return _each_batch(spark, listings, state_path, checkpoint, merge)
