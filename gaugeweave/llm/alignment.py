"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level BPE, B a SentencePiece model. Both encode a blank and the text (B adds that blank itself). Each byte has a label: no token
ends there, one of A, one of B, or both. A regular expression scans the label string for spans up to each label "both"; the labels counted in a span say how
many tokens of A and B its group has. A and a B token are linked if their byte ranges overlap; every byte with a label ends exactly one link.

Both encoders split a text at the edges of its runs (:data:`gaugeweave.llm.bpe.RUNS`), so a run's groups and links are found once in a Python process
and looked up after that (a table of bounded size). Three steps:

1. Texts become rows of counts, the digest of the groups, and their distinct linked pairs with their numbers. That table is written to the shared
   folder; it is all that later steps read.
2. Pairs are counted over the corpus: summed in each task, then by Spark. The highest count of each B id follows from it.
3. Each text sums the counts of its links. The commonest pairs (at most ``HOT_PAIRS``) are broadcast and looked up in place; each of a text's
   other pairs becomes a narrow row that meets the table of counts by an equi-join. No link is left out.

Results for odd input: null and empty texts, and those whose tokens' bytes differ from the blank and the text (a literal U+2581, or what B normalises),
have no tokens: zeros and the digest ''; they take no part in the counts. Texts are used whole; strings of special tokens are plain text; equal rows are rows of their
own and all count; a null doc_id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, pieces
from .storage import durable, new_folder, text_batches

#: The commonest pairs that are broadcast: at most so many rows of 13 bytes.
HOT_PAIRS = 1 << 20
#: The table of known runs is emptied beyond so many runs or bytes.
KNOWN_RUNS, KNOWN_BYTES = 1 << 18, 1 << 24
A_END, B_END = 1, 2
SPAN = re.compile(rb"[^\x03]*\x03")


class Grow:
    """A numpy array that is appended to."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(2 * end - self.n, self.data.dtype)])
        self.data[self.n : end] = more
        self.n = end


def labels(size: int, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The label of each byte."""
    out = np.zeros(size, np.uint8)
    out[a_ends - 1] |= A_END
    out[b_ends - 1] |= B_END
    return out


def groups(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte ends of the groups, tokens of A up to each end, tokens of B up to each end)."""
    ends = np.array([m.end() for m in SPAN.finditer(label.tobytes())], np.int64)
    return ends, np.cumsum(label & A_END)[ends - 1], np.cumsum(label >> 1)[ends - 1]


def links(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte ends of the links, the number of the A token of each, of the B token): ranges that overlap do so up to the first end of the two."""
    at = np.flatnonzero(label)
    a, b = (label & A_END).astype(np.int64), (label >> 1).astype(np.int64)
    return at + 1, (np.cumsum(a) - a)[at], (np.cumsum(b) - b)[at]


class Aligner:
    """Groups and links of runs, in one Python process."""

    def __init__(self, vocabulary: bpe.Vocabulary, model: pieces.Pieces):
        import sentencepiece
        import tiktoken

        # The ids of such a vocabulary are its merge order, so it can be read as ranks.
        tokens = {s: i for i, s in enumerate(vocabulary.shown) if s and i not in vocabulary.added.values()}
        if vocabulary.made != sorted(vocabulary.made):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        if any("\n" in p or re.search(f"[^{pieces.BLANK}]{pieces.BLANK}", p) for p, _, _ in model.rows):
            raise ValueError("a piece reaches over a blank or a line end")
        self.a = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        shown = pieces._piece_bytes(model)
        self.width = max(shown) + 1
        self.a_table = bpe.byte_table(vocabulary.shown)
        self.b_table = bpe.byte_table([shown.get(i, b"") for i in range(self.width)])
        self.names = [str(i) for i in range(max(len(vocabulary.shown), self.width))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.text = 0, []
        self.ok, self.n_a, self.n_b, self.n_groups, self.first, self.n_links = Grow(bool), *(Grow(np.int64) for _ in range(5))
        self.pairs = Grow(np.int64)

    def learn(self, runs: list[str]) -> None:
        """Appends what is known of distinct new ``runs``; each begins with white space."""
        # each ends where the next one's blank or line end begins, but for a text's last one, which may end in white space
        inner, outer = [r for r in runs if not r[-1].isspace()], [r for r in runs if r[-1].isspace()]
        runs = inner + outer
        raw = [r.encode() for r in runs]
        size = np.array([len(x) for x in raw], np.int64)
        a = np.array(self.a.encode_ordinary("".join(inner)), np.int64)
        last = np.searchsorted(np.cumsum(np.diff(self.a_table[1])[a]), np.cumsum(size[: len(inner)]), "left") + 1
        rest = [self.a.encode_ordinary(r) for r in outer]
        a = np.concatenate([a, np.fromiter(chain.from_iterable(rest), np.int64)])
        n_a = np.concatenate([np.diff(last, prepend=0), np.array([len(x) for x in rest], np.int64)])
        b_lists = [x[2:] for x in self.b.encode(["\n" + r for r in runs], num_threads=1)]
        n_b = np.array([len(x) for x in b_lists], np.int64)
        b = np.fromiter(chain.from_iterable(b_lists), np.int64, int(n_b.sum()))
        ok = self._equal(a, n_a, self.a_table, raw, size) & self._equal(b, n_b, self.b_table, raw, size)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        label = labels(int(size[ok].sum()), np.cumsum(np.diff(self.a_table[1])[a]), np.cumsum(np.diff(self.b_table[1])[b]))
        bounds = np.concatenate([[0], np.cumsum(size * ok)])  # of the runs' bytes in the label string
        g_ends, g_a, g_b = groups(label)
        l_ends, l_a, l_b = links(label)
        n_groups, n_links = (np.diff(np.searchsorted(e, bounds, "right")) for e in (g_ends, l_ends))
        names = self.names
        sa, sb = [names[i] for i in a.tolist()], [names[i] for i in b.tolist()]
        each = [f"{','.join(sa[p:q])}|{','.join(sb[u:v])}" for p, q, u, v in zip([0, *g_a[:-1].tolist()], g_a.tolist(), [0, *g_b[:-1].tolist()], g_b.tolist(), strict=False)]
        last = np.cumsum(n_groups).tolist()
        self.text += [";".join(each[s:e]) for s, e in zip([0, *last[:-1]], last, strict=True)]
        self.first.add(self.pairs.n + np.cumsum(n_links) - n_links)
        self.pairs.add(a[l_a] * self.width + b[l_b])
        for to, x in ((self.ok, ok), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links)):
            to.add(x)
        self.number.update(zip(runs, range(len(self.number), len(self.number) + len(runs)), strict=True))
        self.size += int(size.sum())

    @staticmethod
    def _equal(ids: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray], raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether each run's tokens show its bytes."""
        width = np.concatenate([[0], np.cumsum(np.diff(table[1])[ids])])
        ends = np.cumsum(n)
        ok = width[ends] - width[ends - n] == size
        shown = np.frombuffer(bpe.shown_bytes(ids[np.repeat(ok, n)], table), np.uint8)
        want = np.frombuffer(b"".join([x for x, y in zip(raw, ok.tolist(), strict=True) if y]), np.uint8)
        ends = np.cumsum(size * ok)
        wrong = np.concatenate([[0], np.cumsum(shown != want)])
        return ok & (wrong[ends] == wrong[ends - size * ok])

    def __call__(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """What step 1 gives for each text."""
        if len(self.number) > KNOWN_RUNS or self.size > KNOWN_BYTES:
            self.clear()
        runs = [bpe.RUNS.findall(" " + t) if t else [] for t in texts]
        new = [r for r in dict.fromkeys(chain.from_iterable(runs)) if r not in self.number]
        if new:
            self.learn(new)
        many = np.array([len(x) for x in runs], np.int64)
        k = np.fromiter(map(self.number.__getitem__, chain.from_iterable(runs)), np.int64, int(many.sum()))
        ends = np.cumsum(many)
        sums = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[ends] - c[ends - many]
        good = (many > 0) & (sums(~self.ok.data[k]) == 0)
        out = {c: pa.array(sums(x.data[k]) * good, pa.int64()) for c, x in (("n_a", self.n_a), ("n_b", self.n_b), ("n_groups", self.n_groups), ("n_links", self.n_links))}
        numbers, text, stop = k.tolist(), self.text, ends.tolist()
        out["groups_sha256"] = pa.array([hashlib.sha256(";".join([text[x] for x in numbers[e - m : e]]).encode()).hexdigest() if y else "" for e, m, y in zip(stop, many.tolist(), good.tolist(), strict=True)])
        k = k[np.repeat(good, many)]
        n = self.n_links.data[k]
        held = pieces._ranges(self.pairs.data[: max(1, self.pairs.n)], self.first.data[k], n)
        owner = np.repeat(np.repeat(np.arange(len(texts)), many * good), n)
        distinct, times = np.unique(owner << 40 | held, return_counts=True)
        offsets = pa.array(np.searchsorted(distinct, np.arange(len(texts) + 1) << 40).astype(np.int32))
        out["pairs"] = pa.ListArray.from_arrays(offsets, pa.array(distinct & ((1 << 40) - 1), pa.int64()))
        out["times"] = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
        return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def text_links(docs: DataFrame, vocabulary: bpe.Vocabulary, model: pieces.Pieces, text_col: str = "text") -> DataFrame:
    """Step 1: (row, doc_id, the counts, groups_sha256, pairs, times); pairs are A's id * B's size + B's id."""
    shared = docs.sparkSession.sparkContext.broadcast([vocabulary, model])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # one list for all tasks of a Python process
        if len(state) == 2:
            state.append(Aligner(*state))
        for b in batches:
            at = 0
            while at < b.num_rows:
                first, size, texts = at, 0, []
                while at < b.num_rows and size < 1 << 19:
                    texts.append(b.column(2)[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                got = state[2](texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, at - first), b.column(1).slice(first, at - first), *got.values()], names=["row", "doc_id", *got])

    schema = f"row long, doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<long>, times array<int>"
    return text_batches(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text_col).alias("_text")).mapInArrow(run, schema)


def pair_counts(texts: DataFrame, width: int, flush: int = 1 << 20) -> DataFrame:
    """Step 2: (pair, n, best): how many links of the corpus hold each pair; whether that is the highest number of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            more = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            every, of = np.concatenate([keys, more[0]]), np.concatenate([sums, more[1]])
            keys, at = np.unique(every, return_inverse=True)
            sums = np.bincount(at, of, len(keys)).astype(np.int64)
            if len(keys) > flush:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    counts = durable(texts.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = durable(counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most")))  # one row for each id of B
    best = counts.join(F.broadcast(most), counts["pair"] % width == most["b"])
    return durable(best.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def hot_pairs(counts: DataFrame, hot: int = HOT_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in order, their counts, whether best): those common enough for at most ``hot`` to be."""
    step = F.floor(F.log2("n") * 32)
    total, least = 0, None
    for bin_, n in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 2,048 bins
        total += n
        if total > hot:
            break
        least = bin_
    got = (counts.filter(step >= least) if least is not None else counts.limit(0)).toArrow()
    keys = got["pair"].to_numpy()
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy()[order], got["best"].to_numpy()[order]


def scored(texts: DataFrame, counts: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """Step 3: the texts with n_best and count_sum."""
    shared = texts.sparkSession.sparkContext.broadcast(hot_pairs(counts, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for b in batches:
            size = np.diff(b.column("pairs").offsets.to_numpy())
            pairs, times = b.column("pairs").flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            ends = np.cumsum(size)
            sums = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[ends] - c[ends - size]
            held = np.where(known, n[at] * times, 0) if len(keys) else np.zeros(len(pairs), np.int64)
            top = np.where(known, best[at] * times, 0) if len(keys) else held
            rows = b.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("row"), *(b.column(c) for c in ("doc_id", *COUNTS, "groups_sha256")), pa.array(sums(top)), pa.array(sums(held)), pa.array(-1 - rows), pa.array(np.zeros(len(rows), np.int64))], names=names)
            cold = np.flatnonzero(~known)
            none = lambda kind: pa.nulls(len(cold), kind)
            if len(cold):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, size)[cold]), none(b.schema.field("doc_id").type), *(none(pa.int64()) for _ in COUNTS), none(pa.string()), pa.array(np.zeros(len(cold), np.int64)), pa.array(np.zeros(len(cold), np.int64)), pa.array(pairs[cold]), pa.array(times[cold])], names=names)

    names = ["row", "doc_id", *COUNTS, "groups_sha256", "top", "held", "pair", "times"]
    schema = f"row long, doc_id {dict(texts.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, top long, held long, pair long, times long"
    # a text's own row has a pair below 0 that no other has: it meets no count, and no key is null
    parts = text_batches(texts).mapInArrow(run, schema).join(counts.hint("merge"), "pair", "left")
    n_best = F.sum(F.col("top") + F.when(F.col("best"), F.col("times")).otherwise(0))
    count_sum = F.sum(F.col("held") + F.coalesce(F.col("n") * F.col("times"), F.lit(0)))
    got = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in COUNTS), n_best.alias("n_best"), count_sum.alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return got.drop("row")


def alignments(docs: DataFrame, vocabulary: bpe.Vocabulary | None = None, model: pieces.Pieces | None = None, text_col: str = "text", hot: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    spark = docs.sparkSession
    vocabulary, model = vocabulary or bpe.Vocabulary.from_json(), model or pieces.Pieces.from_model()
    folder = new_folder(spark, "alignment")
    text_links(docs, vocabulary, model, text_col).write.option("compression", "zstd").parquet(folder)
    texts = spark.read.parquet(folder)
    return scored(texts, pair_counts(texts, max(pieces._piece_bytes(model)) + 1), hot)
