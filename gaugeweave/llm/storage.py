"""The shared folder, durable intermediate tables, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.shared import BROADCAST_ROWS, durable, free_name, new_folder, shared_dir, sized_join

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "durable", "free_name", "new_folder", "partitions", "shared_dir", "sized_join", "skew_join", "text_batches"]

#: Strings of any length are summed as well, and broadcast only up to this many bytes.
BROADCAST_BYTES = 64 << 20


def text_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, whose texts go to Python in batches of at most ``rows`` from now on (a setting of the session; a smaller one stays). Spark ends
    a batch also at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB where nothing else is set), so long texts come in batches of few rows.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return docs


def skew_join(big: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """``big`` joined with ``small`` (key, n, ...; one row a key, durable), whose n counts the key's rows in ``big``, ``total`` in all.

    Keys of more than a 500th of all rows, and more than 4,096, are joined by broadcast: there can't be more than 500 of them. So no task gets a hot key.
    """
    least = max(4096, total // 500)
    hot = F.broadcast(small.filter(F.col("n") > least))
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key)
    rest = big.join(hot.select(key), key, "left_anti").join(small.filter(F.col("n") <= least), key)
    return big.join(hot, key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
