"""Change detection between the stored file state and a new listing, and its merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(state: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state) of every path in ``state`` (path, fingerprint, processed) or ``listing`` (path, fingerprint): gone, new, changed, pending or unchanged."""
    b = listing.select("path", F.col("fingerprint").alias("_now"), F.lit(True).alias("_listed"))
    a = state.withColumn("_known", F.lit(True))
    state_of = F.when(F.col("_listed").isNull(), "gone").when(F.col("_known").isNull(), "new").when(~F.col("fingerprint").eqNullSafe(F.col("_now")), "changed").when(~F.coalesce("processed", F.lit(False)), "pending").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", state_of.alias("state"), "fingerprint", F.col("_now").alias("new_fingerprint"), "processed")


def moves(changed: DataFrame) -> DataFrame:
    """(path, moved_from): new paths whose fingerprint a path that is gone had; the largest such path where there are several."""
    gone = changed.filter("state = 'gone'").groupBy(F.col("fingerprint").alias("new_fingerprint")).agg(F.max("path").alias("moved_from"))
    return changed.filter("state = 'new'").join(gone, "new_fingerprint").select("path", "moved_from")


def merge(state: DataFrame, listing: DataFrame) -> DataFrame:
    """The state after a scan: listed paths with their new fingerprint; changed and new ones are unprocessed."""
    c = changes(state, listing).filter("state <> 'gone'")
    return c.select("path", F.col("new_fingerprint").alias("fingerprint"), (F.col("state") == "unchanged").alias("processed"))


# the whole state machine of a repository scan
SCAN = "rel_path string, file_fingerprint string, size_bytes long, mtime_ns long, first_seen_epoch_ns long, last_seen_epoch_ns long, last_processed_epoch_ns long, last_processed_mtime_ns long, needs_processing boolean"


def scan(state: DataFrame, listing: DataFrame, now_ns: int, last_scan_ns: int = 0) -> DataFrame:
    """The state after a scan, with ``reason`` where a file needs processing or has moved.

    ``state`` has :data:`SCAN`. ``listing`` has rel_path, size_bytes, mtime_ns, has_token (its metadata names artifacts), token_ok (these exist) and
    artifacts_ok (the expected ones exist). A new path with the fingerprint of a known one that is gone has moved; of several the one seen last. Files that
    aren't listed keep their row.
    """
    s, f = state.alias("s"), listing.withColumn("file_fingerprint", F.concat_ws(":", "size_bytes", "mtime_ns"))
    gone = state.join(listing.select("rel_path"), "rel_path", "left_anti")
    old = gone.groupBy("file_fingerprint").agg(F.max_by(F.struct("rel_path", "first_seen_epoch_ns", "last_processed_epoch_ns", "last_processed_mtime_ns", "needs_processing"), F.struct("last_seen_epoch_ns", "rel_path")).alias("m"))
    both = f.join(s.select("rel_path", F.struct("s.*").alias("k")), "rel_path", "left").join(old, "file_fingerprint", "left")
    # one new path takes over a moved file's row; further copies of it are new
    first = F.min(F.when(F.col("k").isNull() & F.col("m").isNotNull(), F.col("rel_path"))).over(Window.partitionBy("file_fingerprint"))
    both = both.withColumn("m", F.when(F.col("k").isNull() & (F.col("rel_path") == first), F.col("m")))
    done = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    k = F.col("k")
    known = (
        F.when(F.coalesce(k.needs_processing, F.lit(False)), "pending").when(~done("k.last_processed_epoch_ns"), "never_processed")
        .when((F.lit(last_scan_ns) > 0) & done("k.last_seen_epoch_ns") & (k.last_seen_epoch_ns < last_scan_ns) & (F.col("mtime_ns") > last_scan_ns), "reappeared")
        .when(F.col("mtime_ns") != k.mtime_ns, "changed").when(done("k.last_processed_mtime_ns") & (F.col("mtime_ns") != k.last_processed_mtime_ns), "changed")
        .when((F.lit(last_scan_ns) > 0) & (F.col("mtime_ns") > last_scan_ns), "new_since_last_scan")
    )
    moved = F.when(done("m.last_processed_epoch_ns"), "moved").otherwise("moved_unprocessed")
    why = F.when(k.isNotNull(), known).when(F.col("m").isNotNull(), moved).otherwise("new")
    both = both.withColumn("_why", why).withColumn("_must", F.col("_why").isNotNull() & (F.col("_why") != "moved"))
    token, ok = F.coalesce("has_token", F.lit(False)), F.coalesce("token_ok", F.lit(False))
    # an unprocessed file whose metadata names artifacts that exist is done; one whose artifacts are missing is not, whatever the state says
    by_token = F.when((F.col("_must") | k.isNotNull()) & token & ~ok, "metadata_missing_artifacts").when(F.col("_must") & token & ok, "metadata_present")
    both = both.withColumn("_token", by_token)
    both = both.withColumn("_why", F.coalesce("_token", "_why")).withColumn("_must", F.when(F.col("_token") == "metadata_present", F.lit(False)).when(F.col("_token").isNotNull(), F.lit(True)).otherwise(F.col("_must")))
    lacking = ~F.coalesce("artifacts_ok", F.lit(False)) & (k.isNull() | done("k.last_processed_epoch_ns"))
    both = both.withColumn("_why", F.when(lacking, F.coalesce("_why", F.lit("missing_artifacts"))).otherwise(F.col("_why"))).withColumn("_must", F.col("_must") | lacking)
    was = lambda c: F.coalesce(F.col(f"k.{c}"), F.col(f"m.{c}"))
    processed = F.coalesce(F.when(done("k.last_processed_epoch_ns"), F.col("k.last_processed_epoch_ns")), F.when(done("m.last_processed_epoch_ns"), F.col("m.last_processed_epoch_ns")), F.when(F.col("_token") == "metadata_present", F.lit(now_ns)))
    seen = both.select(
        "rel_path", "file_fingerprint", "size_bytes", "mtime_ns", F.coalesce(was("first_seen_epoch_ns"), F.lit(now_ns)).cast("long").alias("first_seen_epoch_ns"), F.lit(now_ns).cast("long").alias("last_seen_epoch_ns"),
        processed.cast("long").alias("last_processed_epoch_ns"), was("last_processed_mtime_ns").alias("last_processed_mtime_ns"), (F.col("_must") | F.coalesce(was("needs_processing"), F.lit(False))).alias("needs_processing"), F.col("_why").alias("reason"),
    )
    taken = both.filter("m is not null").select(F.col("m.rel_path").alias("rel_path"))
    return seen.unionByName(gone.join(taken, "rel_path", "left_anti").select("*", F.lit(None).cast("string").alias("reason")))


def artifacts_folder(path: Column, excel_suffix: str = "__excel") -> Column:
    """Where a file's artifacts are expected, below the support folder."""
    from gaugeweave.functions.identities import stem

    name = F.when(stem(path) == "", "unknown").otherwise(stem(path))
    return F.concat(F.lit("debug/ocr/"), name, F.when(F.lower(path).rlike(r"\.(xlsx|xls|xlsm)$"), excel_suffix).otherwise(""))


def with_artifacts(listing: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Listed files with artifacts_ok: a combined text or a metadata file is in their folder. ``artifacts`` lists the files below the support folder (rel_path)."""
    named = artifacts.withColumn("_name", F.regexp_extract("rel_path", r"[^/\\]*$", 0))
    good = named.filter((F.col("_name") == "combined.txt") | F.col("_name").rlike(r"[_.]metadata\.json$")).select(F.regexp_replace("rel_path", r"/[^/]*$", "").alias("_folder")).distinct()
    return listing.withColumn("_folder", artifacts_folder(F.col("rel_path"))).join(good.withColumn("artifacts_ok", F.lit(True)), "_folder", "left").withColumn("artifacts_ok", F.coalesce("artifacts_ok", F.lit(False))).drop("_folder")


def watermark(meta: DataFrame, now_ns: int, key: str = "last_scan_epoch_ns") -> DataFrame:
    """The meta table (key, value) with the scan's time."""
    return meta.filter(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, str(now_ns))], "key string, value string"))


def to_write(wanted: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """What is to be made: all, or what doesn't exist yet (path)."""
    return wanted if overwrite else wanted.join(existing.select("path").distinct(), "path", "left_anti")


def to_mirror(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Files (path, size_bytes, mtime_ns) that a mirror lacks or has with another size or time."""
    there = copy.select("path", F.col("size_bytes").alias("_s"), F.col("mtime_ns").alias("_m"))
    return source.join(there, "path", "left").filter(~(F.col("_s").eqNullSafe(F.col("size_bytes")) & F.col("_m").eqNullSafe(F.col("mtime_ns")))).select(*source.columns)


def to_process(state: DataFrame, forced: DataFrame | None = None, only_forced: bool = False) -> DataFrame:
    """Files of a run: those that need it, the newest first; forced ones too, or alone."""
    if forced is None:
        return state.filter("needs_processing").orderBy(F.desc("mtime_ns"), "rel_path")
    hit = state.join(forced.select("rel_path", F.lit(True).alias("_f")).distinct(), "rel_path", "left").withColumn("_f", F.coalesce("_f", F.lit(False)))
    return hit.filter("_f" if only_forced else "_f or needs_processing").drop("_f").orderBy(F.desc("mtime_ns"), "rel_path")


def processed(state: DataFrame, results: DataFrame, now_ns: int) -> DataFrame:
    """The state after a run: files that went well are done as of their time, failed ones wait. ``results``: (rel_path, ok)."""
    r = results.groupBy("rel_path").agg(F.bool_and("ok").alias("_ok"))
    done = F.coalesce("_ok", F.lit(False))
    new = {"last_processed_epoch_ns": F.when(done, F.lit(now_ns).cast("long")).otherwise(F.col("last_processed_epoch_ns")), "last_processed_mtime_ns": F.when(done, F.col("mtime_ns")).otherwise(F.col("last_processed_mtime_ns")), "needs_processing": F.when(done, F.lit(False)).otherwise(F.col("needs_processing"))}
    return state.join(r, "rel_path", "left").withColumns(new).drop("_ok")
