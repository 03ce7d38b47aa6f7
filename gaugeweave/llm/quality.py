"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class (label 0 and 1) has a mean and a covariance of the transformed statistics; a covariance is shrunk towards its
diagonal, and a little towards the unit matrix. A document's score is the posterior of class 1 from the difference of the
two Gaussian log-densities, each from the Mahalanobis distance by the class's Cholesky factor, which is computed once and
cached in the model. Statistics are computed once a document in whole, stored (a few hundred bytes a row), then read for the
class sums (one distributed aggregate over all labelled rows, no sample) and for the scores.

Results for odd input: a null text counts as the empty one; empty texts get a score; texts are used whole; a null doc_id gives
a score and is never learned from; labels with null quality are left out; a document with several label rows is learned from
once for each; with fewer than two classes among the labelled rows every score is the share of class 1 (0.5 without any); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import durable, sized_join, text_batches

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\f",
    "line": b"\n",
    "stop": b".?",
    "bang": b"!",
    "comma": b",;:'\"()-",
    "bar": b"|",
    "odd": b"#$%&*@^~_=+<>{}[]\\/`",
}
STATISTICS = ["log_bytes", *_CLASSES, "high", "word_mean", "word_spread", "distinct_words", "distinct_lines", "top_word", "caps_words", "line_words", "doubled"]


#: A share is taken as if so many more bytes or words of the usual kind had been seen: short texts say little about their shares.
BYTES, WORDS = 150, 20
USUAL = {"lower": 0.79, "upper": 0.02, "digit": 0.002, "space": 0.15, "line": 0.004, "stop": 0.012, "bang": 0.0005, "comma": 0.006, "bar": 0.0005, "odd": 0.001, "high": 0.03}


def _odds(x: np.ndarray, of: np.ndarray, more: float, usual: float) -> np.ndarray:
    p = (x + more * usual) / (of + more)
    return np.log(p / np.maximum(1 - p, 1e-4))


def _table() -> np.ndarray:
    out = np.full(256, len(_CLASSES), dtype=np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        out[list(members)] = i
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text: logarithms of counts and log-odds of shares."""
    rows, code = [], _table()
    for first, last, data, offs in K.chunks(texts, lower=False):
        n = last - first
        size = np.diff(offs).astype(float)
        kind = code[data]
        owner = np.repeat(np.arange(n, dtype=np.int64) * 16, np.diff(offs))
        counts = np.bincount(owner + kind, minlength=16 * n).reshape(n, 16).astype(float)
        starts, ends, text = K.words(data, offs)
        bounds = np.searchsorted(text, np.arange(n + 1))
        length = (ends - starts).astype(float)
        n_words = np.diff(bounds).astype(float)
        total, square = K.sums(length, bounds), K.sums(length * length, bounds)
        mean = (total + WORDS * 5) / (n_words + WORDS)
        spread = np.sqrt(np.maximum((square + WORDS * 34) / (n_words + WORDS) - mean * mean, 0))
        caps = K.sums(kind[starts] == 1, bounds) if len(starts) else np.zeros(n)
        doubled = np.zeros(len(data), dtype=bool)
        doubled[1:] = (data[1:] == data[:-1]) & ~K.IN_WORD[data[1:]] & (kind[1:] > 4)
        doubled[offs[:-1][offs[:-1] < len(data)]] = False  # a text's first sign has none before it
        hashes = K.range_hashes(data, starts, ends)
        ends_of_lines = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offs[:-1], ends_of_lines + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))
        lines = K.range_hashes(data, line_starts, line_ends)
        line_bounds = np.searchsorted(line_starts, offs)
        distinct, top, distinct_lines = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                _, times = np.unique(hashes[a:b], return_counts=True)
                distinct[i], top[i] = len(times), times.max()
            a, b = line_bounds[i], line_bounds[i + 1]
            distinct_lines[i] = len(np.unique(lines[a:b])) if b > a else 0
        n_lines = np.diff(line_bounds).astype(float)
        rows.append(np.column_stack([
            np.log1p(size), *[_odds(counts[:, i], size, BYTES, p) for i, p in enumerate(USUAL.values())], np.log(mean), np.log1p(spread),
            _odds(distinct, n_words, WORDS, 0.7), _odds(distinct_lines, n_lines, 2, 0.95), _odds(top, n_words, WORDS, 0.08), _odds(caps, n_words, WORDS, 0.08),
            np.log((n_words + WORDS) / (n_lines + 1)), _odds(K.sums(doubled, offs), size, BYTES, 0.001),
        ]))
    return np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, Cholesky factor of the inverse covariance and its log determinant."""

    prior: list[float] = field(default_factory=lambda: [0.5, 0.5])
    means: np.ndarray | None = None
    factors: list[np.ndarray] | None = None
    log_dets: list[float] | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior[1])
        density = []
        for c in (0, 1):
            z = ((x - self.means[c]) / self.spread) @ self.factors[c]
            density.append(np.log(self.prior[c]) - 0.5 * (z * z).sum(1) - 0.5 * self.log_dets[c])
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / self.temperature, -700, 700)))


def with_statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, stats): the transformed statistics of every whole text, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            flat = pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[id_col, "stats"])

    return durable(text_batches(docs).select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, stats array<double>"))


def fit(labelled: DataFrame, shrinkage: float = 0.3, ridge: float = 0.05, temperature: float = 1.0) -> Model:
    """Fits on all rows (label, stats): class counts, sums and sums of products come from one distributed aggregate."""
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                m = x[y == c]
                n[c] += len(m)
                s[c] += m.sum(0)
                q[c] += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([n.ravel().tolist()]), pa.array([s.ravel().tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    parts = labelled.select("label", "stats").mapInArrow(moments, "n array<double>, s array<double>, q array<double>")
    total = parts.select(*[F.posexplode(F.concat("n", "s", "q")).alias("i", "v")]).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for i, v in total:
        flat[i] = v
    n, s, q = flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)
    if n.min() < 2:
        return Model([1 - (n[1] + 0.5) / (n.sum() + 1), (n[1] + 0.5) / (n.sum() + 1)])
    means = s / n[:, None]
    cov = [q[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    spread = np.sqrt(np.maximum((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / n.sum(), 1e-6))
    factors, dets = [], []
    for c in (0, 1):
        scaled = cov[c] / np.outer(spread, spread)
        shrunk = (1 - shrinkage) * scaled + shrinkage * np.diag(np.diag(scaled)) + ridge * np.eye(d)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low).T)
        dets.append(2 * np.log(np.diag(low)).sum())
    return Model(list(n / n.sum()), means, factors, dets, spread, temperature)


def score(stats: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) from stored statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return stats.select(id_col, "stats").mapInArrow(run, f"{id_col} long, score double, predicted int")


def learnable(docs_or_labels: DataFrame, modulus: int, left_out: int, id_col: str = "doc_id") -> DataFrame:
    return docs_or_labels.filter(F.crc32(F.col(id_col).cast("string")) % modulus != left_out)


def _training_labels(labels: DataFrame) -> DataFrame:
    return learnable(labels.filter("quality in (0, 1)"), 5, 0).select("doc_id", F.col("quality").cast("int").alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; learned from labels whose crc32(doc_id) mod 5 is not 0. A null doc_id is scored, and not held out."""
    stats = with_statistics(docs)
    model = fit(sized_join(stats, durable(_training_labels(labels)), "doc_id"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return score(stats, model).select("doc_id", held, "score", "predicted")


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learned from the labelled rows of ``docs``; statistics are computed for these alone."""
    mine = durable(_training_labels(labels))
    known = sized_join(docs, durable(mine.select("doc_id").distinct()), "doc_id", "left_semi")
    return fit(with_statistics(known).join(mine, "doc_id"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model accepts, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column(b.schema.get_field_index(text_col)))) >= threshold))

    return text_batches(docs).mapInArrow(run, docs.schema)
