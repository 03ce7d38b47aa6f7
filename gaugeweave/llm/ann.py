"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Fit, on a bounded sample of rows: principal axes, then a rotation learned so that the signs of the rotated vectors lose least
(iterative quantisation); from the same sample comes the Hamming radius within which the wanted share of true neighbours lies.
Index: every row's code is cut into substrings, each with a table from its value to the rows that have it. Search: two codes
within the radius r differ in some substring of s by at most floor(r / s) bits (pigeonhole), so all values within that distance
of the query's substring are probed; what the tables give, is checked for the full distance, and the float vectors of
what remains are ranked exactly by inner product. A query with fewer than k codes in the radius doubles it until it has k
or has probed everything. Rows are indexed block by block (see :mod:`.vectors`), all of them, each once; queries stream through.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; a
query's own id is no candidate, however often it is there; equal vectors tie to the smaller vec_id; with fewer than k candidates
all come; an empty table gives no rows; further columns are ignored. Vectors of each length are searched among themselves, as there is no
inner product across lengths; codes are learned for every length in the sample, and rows of a length that isn't in it are all ranked
exactly. A repeated vec_id is a candidate each time; as a query it stands for its least vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Codes:
    center: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes: one substring of eight bits a byte."""
        return np.packbits((x - self.center) @ self.rotation > 0, axis=1)


def fit(sample: np.ndarray, n_rows: int, k: int = V.K_BEST, recall: float = 0.97, rounds: int = 20, seed: int = 3) -> Codes:
    """Rotation by iterative quantisation; radius from the distances of the sample's own neighbours, as many of them as stand for k among all rows."""
    center = sample.mean(0)
    x = sample - center
    _, axes = np.linalg.eigh(x.T @ x)
    y = x @ axes[:, ::-1]
    rot, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(y.shape[1], y.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ rot > 0, 1.0, -1.0).T @ y)
        rot = (u @ vt).T
    codes = Codes(center, axes[:, ::-1] @ rot, 0)
    bits = codes.of(sample)
    near = max(1, round(k * len(sample) / max(n_rows, 1)))
    apart = []
    for i in range(0, len(sample), max(1, len(sample) // 400)):
        s = sample @ sample[i]
        s[i] = -np.inf
        apart += POPCOUNT[bits[np.argsort(-s)[:near]] ^ bits[i]].sum(1).tolist()
    return Codes(codes.center, codes.rotation, int(np.quantile(apart, recall)) if apart else bits.shape[1] * 8)


class Index:
    """Tables from the value of each substring to the rows that have it, for one block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.order = np.argsort(bits, axis=0, kind="stable").astype(np.int32)
        self.bounds = np.stack([np.searchsorted(bits[self.order[:, j], j], np.arange(257)) for j in range(bits.shape[1])]) if len(bits) else np.zeros((bits.shape[1], 257), int)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        s = self.bits.shape[1]
        seen = np.zeros(len(self.bits), dtype=bool)
        for j in range(s):
            values = np.flatnonzero(POPCOUNT[np.arange(256) ^ int(code[j])] <= radius // s)
            start, lengths = self.bounds[j, values], self.bounds[j, values + 1] - self.bounds[j, values]
            seen[self.order[np.repeat(start - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()), j]] = True
        at = np.flatnonzero(seen)
        return at[POPCOUNT[self.bits[at] ^ code].sum(1, dtype=np.int32) <= radius]


def search(vectors: DataFrame, k: int = V.K_BEST, every: int = 20, sample_rows: int = 8000, rows_in_block: int = 1 << 15) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every`` against all rows. About ``sample_rows`` rows are fitted on, at most twice as many."""
    nonzero = vectors.filter(F.exists("embedding", lambda x: x != 0))
    rows, queries = V.prepare(nonzero, every, F.transform("embedding", lambda x: x.cast("double")))
    lengths = {r.d: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(64).collect()}
    n = rows.count()
    part = min(1.0, sample_rows / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "id", "v"), F.lit(1 << 30))
    drawn = rows.filter(draw < int(part * (1 << 30))).select("v").orderBy(draw, "v").limit(2 * sample_rows).toArrow()["v"].combine_chunks()
    sizes, flat = drawn.value_lengths().to_numpy(zero_copy_only=False), drawn.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    codes = {}
    for d, count in lengths.items():
        at = np.flatnonzero(sizes == d)
        if len(at) > k:
            sample = np.stack([flat[ends[i] - d : ends[i]] for i in at])
            codes[d] = fit(sample[np.lexsort(sample.T)], count, k)

    def block(ids: np.ndarray, x: np.ndarray):
        if x.shape[1] not in codes:
            every_row = np.arange(len(ids))
            return lambda query_ids, q: (_best(every_row[ids != i], x, ids, v, i, k) for i, v in zip(query_ids, q, strict=True))
        learned = codes[x.shape[1]]
        index, top = Index(learned.of(x)), x.shape[1]

        def answers(query_ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for qid, code, v in zip(query_ids, learned.of(q), q, strict=True):
                radius = learned.radius
                at = index.within(code, radius)
                at = at[ids[at] != qid]
                while len(at) < k and radius < top:
                    radius = min(top, max(radius + 1, 2 * radius))
                    at = index.within(code, radius)
                    at = at[ids[at] != qid]
                yield _best(at, x, ids, v, qid, k)

        return answers

    return V.best_of(V.blockwise(rows, queries, rows_in_block, block, "double"), k)


def _best(at: np.ndarray, x: np.ndarray, ids: np.ndarray, v: np.ndarray, query: int, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The query with the ids and scores of the k best of some rows."""
    s = (x[at] * v).sum(1)
    best = V.top_k(s, ids[at], k)
    return query, ids[at][best], s[best]
