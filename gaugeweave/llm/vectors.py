"""What both vector searches share: clean vectors, and blocks of rows through which a stated query set streams.

Rows are dealt by a hash of their id into blocks of at most about ``rows_in_block``, each of one vector length. A row goes to its block once and
a block is indexed once; the queries (a stated small part of the rows) go to every block and stream through it in batches, so
memory holds one block. A block's search returns at most k rows a query, and the k best of all blocks are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import durable

K_BEST = 20


def usable(vector: Column) -> Column:
    """True if the vector and all its components are there and finite."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def blockwise(rows: DataFrame, queries: DataFrame, rows_in_block: int, search: Callable[[np.ndarray, np.ndarray], Callable], score: str) -> DataFrame:
    """(query_id, vec_id, score) from ``search`` on every block: it takes the ids and vectors of the rows and returns a function of the ids and vectors of some queries of the same length.

    ``rows`` and ``queries`` (id, v) are durable. Small tables have a block for each core, of at least a quarter of ``rows_in_block``.
    """
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / rows_in_block), min(cores, n * 4 // rows_in_block))
    a = rows.select(F.pmod(F.xxhash64(F.lit("row"), "id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("is_query"), "id", "v")
    b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "id", "v")
    dealt = a.unionByName(b).select("block", F.size("v").alias("d"), "is_query", "id", "v")
    names, kind = ["query_id", "vec_id", "score"], pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
            """Runs of rows of one (block, d, is_query), at most a batch each."""
            for batch in batches:
                block, d, q, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (d[1:] != d[:-1]) | (q[1:] != q[:-1]), [True]])) if len(ids) else []
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    yield (int(block[s]), int(d[s]), bool(q[s])), ids[s:e], batch.column(4).slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)

        held, parts, index = None, [], None
        for (block, d, is_query), ids, x in runs():
            if held != (block, d):
                held, parts, index = (block, d), [], None
            if not is_query:
                parts.append((ids, x))
                continue
            if index is None and parts:
                index = search(np.concatenate([i for i, _ in parts]), np.concatenate([y for _, y in parts]))
                parts = []
            found = [(np.full(len(i), query), i, s) for query, i, s in index(ids, x)] if index else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), kind), strict=True)], names=names)

    return dealt.repartition(4 * blocks, "block", "d").sortWithinPartitions("block", "d", "is_query").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def best_of(found: DataFrame, k: int = K_BEST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores a query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def prepare(vectors: DataFrame, every: int, value: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, queries) of (id, v), stored. Of rows that repeat a query's id, the query is the least vector (in the order of arrays); as candidates all rows count."""
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), value.alias("v"))
    rows = durable(clean)
    return rows, durable(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
