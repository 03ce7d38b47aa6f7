"""Exact top-k search: an impact-ordered index, processed score-at-a-time.

The components of the quantised vectors are postings, sorted by dimension and value; a segment is a run of postings of one
value. For a query a segment's impact is the product of the query's component and the segment's value. Impacts are quantised into
levels, and all segments of a level, which are one range of each dimension's postings, are processed together, from the
highest level down, adding impacts to their rows' sums. A row can gain at most the lesser of the level's lower edge and the dimension's
greatest impact for each dimension where it hasn't been met. The most promising rows are scored in full, and the k-th best of those scores
is a bound that every member reaches: rows that can't reach it are no members. All rows that this proof leaves are scored exactly, so
processing stops, from the level of impact 0 on, as soon as scoring them costs less than the next level's postings. Blocks
are those of :mod:`.vectors`.

Results for odd input: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; zero
vectors do; a query's own id is no candidate, however often it is there; ties go to the smaller vec_id; with fewer than k
candidates all come; an empty table gives no rows; further columns are ignored; vectors of each length are searched among themselves, as
there is no inner product across lengths; a repeated vec_id is a candidate each time, and as a query stands for its least vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

#: Lower edges of the levels, as parts of the greatest impact above 0 and of the least below it.
ABOVE, BELOW = (1 / 2, 1 / 8, 0.0), (1 / 64, 1 / 16, 1 / 4, 1.0)
#: Scoring a row exactly costs about as much as this many postings.
ROW_COST = 4


class Index:
    """The postings of one block: of each dimension, values in order and their rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.peak = float(np.abs(x).max(initial=0))
        self.dense = x.astype(np.float32 if x.shape[1] * self.peak**2 < 1 << 24 else np.float64)  # sums of products are exact in single precision then
        order = np.argsort(x, axis=0, kind="stable")
        self.rows = [np.ascontiguousarray(order[:, d]) for d in range(x.shape[1])]
        self.values = [x[r, d].astype(np.float64) for d, r in enumerate(self.rows)]

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; one that is no long raises."""
        most = self.x.shape[1] * self.peak * float(np.abs(q).max(initial=0))
        if most >= 1 << 53:
            return np.array([int(s) for s in self.x[at].astype(object) @ q.astype(object)], dtype=np.int64)
        kind = np.float32 if most < 1 << 24 else np.float64
        return (self.dense[at].astype(kind, copy=False) @ q.astype(kind)).astype(np.int64)

    def members(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best; ``own``: rows that are none."""
        n, dims = self.x.shape
        ends = np.array([sorted((float(q[d]) * v[0], float(q[d]) * v[-1])) for d, v in enumerate(self.values)])
        greatest, top, low = ends[:, 1], max(ends[:, 1].max(), 0.0), min(ends[:, 0].min(), 0.0)
        edges = [x * top for x in ABOVE] + [x * low for x in BELOW]
        done = [len(v) if q[d] > 0 else 0 for d, v in enumerate(self.values)]  # postings from here up (down, if q[d] < 0) are done
        sums, met, pending = np.zeros(n), np.zeros(n), []
        can = np.ones(n, dtype=bool)
        can[own] = False
        left = int(can.sum())
        # sums and bounds are rounded: by no more than this, whatever the values
        slack = 1e-6 + 8 * dims * np.finfo(float).eps * dims * self.peak * float(np.abs(q).max(initial=0))
        for i, edge in enumerate(edges):
            parts = []
            for d in range(dims):
                if not q[d]:
                    continue
                v, w = self.values[d], edge / float(q[d])
                to = int(np.searchsorted(v, w, "right" if q[d] > 0 else "left"))
                if i == len(edges) - 1:
                    to = 0 if q[d] > 0 else n
                a, b = (to, done[d]) if q[d] > 0 else (done[d], to)
                if b > a:
                    parts.append((d, a, b))
                    done[d] = to
            if left <= k or i >= len(ABOVE) and ROW_COST * left <= sum(b - a for _, a, b in parts):
                break
            if parts:
                rows = np.concatenate([self.rows[d][a:b] for d, a, b in parts])
                sums += np.bincount(rows, weights=np.concatenate([self.values[d][a:b] * float(q[d]) for d, a, b in parts]), minlength=n)
                pending.append(rows)
            open_most = np.where(q != 0, np.minimum(edge, greatest), 0.0).sum()
            at = np.flatnonzero(can)
            promising = at[np.argpartition(-sums[at], min(4 * k, len(at) - 1))[: 4 * k]]
            bound = float(np.partition(self.scores(promising, q), len(promising) - k)[len(promising) - k])
            if open_most + slack > bound:
                continue  # rows that haven't been met at all could still be members
            if edge and pending:
                met += np.bincount(np.concatenate(pending), minlength=n)
                pending = []
            can[at] = sums[at] + open_most - met[at] * edge >= bound - slack
            left = int(can.sum())
        return np.flatnonzero(can)


def search(vectors: DataFrame, k: int = V.K_BEST, every: int = 20, scale: int = 64, rows_in_block: int = 1 << 15) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x) for the rows whose id is divisible by ``every``."""
    rows, queries = V.prepare(vectors, every, F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))))

    def block(ids: np.ndarray, x: np.ndarray):
        index = Index(x)

        def answers(query_ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for qid, v in zip(query_ids, q, strict=True):
                at = index.members(v, ids == qid, k)
                s = index.scores(at, v)
                best = V.top_k(s, ids[at], k)
                yield qid, ids[at][best], s[best]

        return answers

    return V.best_of(V.blockwise(rows, queries, rows_in_block, block, "long"), k)


def oracle_sql(k: int = V.K_BEST, every: int = 20, scale: int = 64) -> str:
    """Every query against every row in DuckDB, for a small fixture."""
    return f"""WITH q AS (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([(x[1] * x[2])::BIGINT FOR x IN list_zip(a.v, b.v)])::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
