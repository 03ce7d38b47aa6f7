"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text's features are the hashed byte n-grams (n = 2, 3, 4) of its lower-cased letters, with one blank between words. Their
embeddings are averaged over the whole text and go through a linear softmax. As both steps are linear, prediction sums one
precomputed row of class values for each n-gram. Training uses a bounded sample of labelled rows, at most about
``train_docs`` documents spread evenly over the languages (their whole texts); a fifth of it is left out to calibrate
the temperature of the softmax and the score below which a prediction counts as rejected.

Results for odd input: a null text or one without a letter is 'und' with score 0; texts are used whole; rows with null lang are
never learned from; without any labelled row every text is 'und'; with one language all texts with a letter get it; equal rows
get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import text_batches

BITS = 15
NGRAMS = (2, 3, 4)
#: Bytes of letters: ASCII letters and all bytes of characters beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
LETTER[128:] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """([buckets for each n], bounds): n-grams of text i are at bounds[i]..bounds[i + 1] of each list. Runs of other bytes count as
    one blank. A position whose n-gram would leave its text has bucket 2^BITS, which stands for nothing."""
    letter = LETTER[data]
    code = np.where(letter, data, np.uint8(32))
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offs] = True
    keep = letter | np.concatenate([[True], letter[:-1]]) | fresh[:-1]
    code = code[keep].astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(K.sums(keep, offs))])
    out = []
    for n in NGRAMS:
        m = max(len(code) - n + 1, 0)
        gram = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            gram = gram * np.uint32(0x01000193) ^ code[k : k + m]
        bucket = np.full(len(code), 1 << BITS, dtype=np.intp)
        bucket[:m] = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        for k in range(1, n):
            bucket[np.maximum(bounds[1:] - k, bounds[:-1])[bounds[1:] > bounds[:-1]]] = 1 << BITS
        out.append(bucket)
    return out, bounds


def n_grams(bounds: np.ndarray) -> np.ndarray:
    """How many n-grams each text has."""
    size = np.diff(bounds)
    return sum(np.maximum(size - n + 1, 0) for n in NGRAMS)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    rows: np.ndarray  # language x bucket: embedding times output weights; the last bucket is 0
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for first, last, data, offs in K.chunks(texts):
            buckets, bounds = features(data, offs)
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            if not len(full):
                continue
            for c in range(len(self.languages)):
                total = sum(np.add.reduceat(self.rows[c][b], bounds[full]) for b in buckets)
                out[first + full, c] = total / np.maximum(n_grams(bounds)[full], 1)
        return out + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], dim: int = 16, epochs: int = 5, rate: float = 2.0, accept: float = 0.99, seed: int = 1) -> Model:
    """samples: (buckets, shares of the text's n-grams, class). Plain SGD, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    samples = [samples[i] for i in rng.permutation(len(samples))]
    held, used = samples[: len(samples) // 5], samples[len(samples) // 5 :]
    emb = rng.uniform(-1, 1, (1 << BITS, dim)).astype(np.float32) / dim
    out, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            buckets, shares, y = used[i]
            lr = rate * (1 - step / max(steps, 1))
            step += 1
            x = shares @ emb[buckets]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(x, p)
            bias -= 0.1 * lr * p
            emb[buckets] -= lr * shares[:, None] * back[None, :]
    rows = np.concatenate([emb @ out, np.zeros((1, len(languages)), np.float32)]).astype(np.float64)
    z = np.array([s @ rows[b] + bias for b, s, _ in held]) if held else np.zeros((0, len(languages)))
    y = np.array([c for *_, c in held], dtype=int)

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

    temperature = min((2.0**k for k in np.arange(-3, 3.01, 0.25)), key=loss) if len(y) else 1.0
    q = np.exp(z / temperature - (z / temperature).max(1, keepdims=True)) if len(y) else np.zeros((0, 1))
    best = (q / q.sum(1, keepdims=True)).max(1) if len(y) else np.zeros(0)
    return Model(languages, np.ascontiguousarray(rows.T), bias, temperature, float(np.quantile(best, 1 - accept)) if len(best) else 0.0)


def fit(labelled: DataFrame, train_docs: int = 4000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Learns from about ``train_docs`` of the rows, chosen by a hash of the id at an even number for each language (one of each at least).

    At most twice as many rows (or as languages, if there are more) come to the driver: those of smallest hash, so that the choice doesn't depend on the order of partitions.
    """
    counts = {r[0]: r[1] for r in labelled.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    each = max(1, train_docs // len(languages))
    part = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, each / counts[k])))])[F.col(lang_col)]
    draw = F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(F.col(lang_col).isNotNull() & (draw < part)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (draw / part).alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            for first, last, data, offs in K.chunks(b.column(1)):
                buckets, bounds = features(data, offs)
                found = [np.unique(g[g < 1 << BITS], return_counts=True) for g in (np.concatenate([x[s:e] for x in buckets]) for s, e in zip(bounds[:-1], bounds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(langs[first:last]), b.column(2).slice(first, last - first), pa.array([x.astype(np.uint16).tobytes() for x, _ in found]), pa.array([(n / max(n.sum(), 1)).astype(np.float32).tobytes() for _, n in found])], names=["lang", "draw", "buckets", "shares"])

    found = text_batches(chosen).mapInArrow(run, "lang string, draw double, buckets binary, shares binary")
    got = found.orderBy("draw", "lang", "buckets", "shares").limit(2 * max(train_docs, len(languages)) + 100).collect()
    samples = [(np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.shares, np.float32), languages.index(r.lang)) for r in sorted(got, key=lambda r: (r.lang, r.buckets, r.shares)) if r.buckets]
    return train(samples, languages) if samples else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, rejected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = has_letter(b.column(1))
            best, p = model.predict(b.column(1)) if model else (np.zeros(b.num_rows, int), np.zeros(b.num_rows))
            known = known & (model is not None)
            names = [model.languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
            p = np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(p), pa.array(~known | (p < (model.reject_below if model else 1.0)))], names=[id_col, "lang_pred", "score", "rejected"])

    return text_batches(docs).select(id_col, text_col).mapInArrow(run, f"{id_col} long, lang_pred string, score double, rejected boolean")


def language_predictions(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected; learned where crc32(doc_id) mod 3 is not 1. A null doc_id gets a prediction, and is not held out."""
    turn = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.filter(turn != 1))
    return identify(docs, model).select("doc_id", F.coalesce(turn == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
