"""The shared folder, durable intermediate tables, and joins whose small side is measured first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has no more rows than this; callers pass rows of a few dozen bytes.
BROADCAST_ROWS = 500_000
#: The bitmap that stands for a larger side has at most so many bits (2^20 rows of 16 bytes).
MOST_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where a local session names none (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gaugeweave-')}"
    if not _checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(found)
    return found


def _checkpoint_dir(spark: SparkSession) -> str | None:
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    return got.get() if got.isDefined() else None


def durable(df: DataFrame) -> DataFrame:
    """Written once to the shared folder; later reads survive the loss of any executor and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def free_name(taken: list[str], base: str) -> str:
    """``base``, with underscores after it until no column has the name."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base += "_"
    return base


def bitmap(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(word, bits) of the hashed keys of ``n`` rows, 64 bits a row, and the number of bits: 16 for each key, from 2^16 to ``MOST_BITS``."""
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * n - 1).bit_length()))
    place = F.xxhash64(*keys.columns).bitwiseAND(size - 1)
    bits = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    return bits, size


def may_have(big: DataFrame, on: list[str], words: DataFrame, size: int) -> tuple[DataFrame, str]:
    """``big`` with a column that tells whether the bitmap may hold a row's keys (never for null keys), and that column's name."""
    word, bits, maybe = (free_name(big.columns, x) for x in ("_word", "_bits", "_maybe"))
    place = F.xxhash64(*on).bitwiseAND(size - 1)
    marked = big.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left")
    held = F.expr(f"shiftright(`{bits}`, cast(xxhash64({', '.join(f'`{c}`' for c in on)}) & 63 as int)) & 1L = 1L")
    known: Column = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    return marked.withColumn(maybe, F.coalesce(known & held, F.lit(False))).drop(word, bits), maybe


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` must be durable: it is counted and broadcast if it has at most ``limit`` rows.

    Beyond, a broadcast bitmap of its hashed keys tells which rows of ``big`` may have a partner (inner, left, left_semi, left_anti). Only those shuffle, so
    wide rows of ``big`` without one stay where they are; the bitmap has a bounded size and lets more rows pass where there are more keys than it has room for.
    """
    n = small.count()
    if n <= limit:
        return big.join(F.broadcast(small), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        return big.join(small.hint("merge"), keys, how)
    words, size = bitmap(small.select(*keys), n)
    marked, maybe = may_have(big, keys, durable(words), size)
    joined = marked.filter(maybe).drop(maybe).join(small.hint("merge"), keys, how)
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(marked.filter(~F.col(maybe)).drop(maybe), allowMissingColumns=True)


def keyed_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block: int = 1024) -> DataFrame:
    """The inner join of two tables on ``key``, whose common keys are dealt into pairs of blocks of about ``block`` rows: no task gets a whole long list."""
    n = left.groupBy(key).count().unionByName(right.groupBy(key).count()).groupBy(key).agg(F.max("count").alias("_n")).filter(F.col("_n") > block)
    sizes = durable(n.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    one = F.coalesce("_blocks", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), one - 1))
    a = sized_join(left, sizes, key, "left").withColumn("_i", F.pmod(F.xxhash64(left_id), one).cast("int")).withColumn("_j", every).drop("_blocks")
    b = sized_join(right, sizes, key, "left").withColumn("_j", F.pmod(F.xxhash64(right_id), one).cast("int")).withColumn("_i", every).drop("_blocks")
    return a.join(b, [key, "_i", "_j"]).drop("_i", "_j")
