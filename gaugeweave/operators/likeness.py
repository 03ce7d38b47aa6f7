"""Texts alike by matching blocks, without comparing every two: an index of short substrings gives candidates, and loses none.

The ratio of two texts is 2 m / s, m the characters in their matching blocks and s both lengths. At a ratio of r or more, m >= r s / 2, the unmatched characters are at most d = s - 2 m, and there
are at most d + 1 blocks. So the two share m - (q - 1)(d + 1) substrings of q characters at least, at places that differ by no more than the characters unmatched before them.
A text of n substrings is therefore indexed by its rarest ones alone, n minus that number plus one; a pair that reaches r meets in one of them. Texts too
short to share a bigram for sure are indexed by single characters instead. Pairs that meet are counted by letters (an upper bound of the ratio) before blocks are matched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions.fuzzy import _ratio
from gaugeweave.shared import durable, keyed_pairs, sized_join


def least_matches(size: int, least: float) -> int:
    """The fewest matching characters of two texts of ``size`` characters together at a ratio of ``least``."""
    return max(1, math.ceil(least * size / 2 - 1e-9))


def least_shared(size: int, least: float, q: int) -> int:
    """The fewest substrings of q characters that two such texts share."""
    m = least_matches(size, least)
    return m - (q - 1) * (size - 2 * m + 1)


def first_bigrams(least: float) -> int:
    """The length from which on two texts that reach ``least`` share a bigram for sure (equal texts apart); a length that no text has where there is none."""
    if least <= 0.67:
        return 1 << 30
    bad = [s for s in range(2, 2000) if least_shared(s, least, 2) < 1 and s > 2 * least_matches(s, least)]
    return max(bad, default=0) // 2 + 2


def lengths_at(size: Column, least: float) -> tuple[Column, Column]:
    """The shortest and the longest text that can reach ``least`` with one of ``size`` characters."""
    return F.ceil(size * F.lit(least / (2 - least)) - 1e-9).cast("int"), F.floor(size * F.lit((2 - least) / least) + 1e-9).cast("int")


def _indexed(texts: DataFrame, q: int) -> DataFrame:
    """(id, size, gram, place) of all substrings of q characters of texts (id, text, size)."""
    return texts.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("size") - (q - 1)))).select("id", "size", "place", F.substring("text", F.col("place"), F.lit(q)).alias("gram"))


def _rarest(grams: DataFrame, freq: DataFrame, q: int, least: float) -> DataFrame:
    """The substrings that a text is indexed by."""
    short, _ = lengths_at(F.col("size"), least)
    both = F.col("size") + short  # the bound grows with the size, so the shortest partner's is the least
    m = both * F.lit(least / 2)
    shared = F.greatest(F.lit(1), F.ceil(m - F.lit(q - 1) * (both - 2 * m + 1) - 1e-6))
    order = Window.partitionBy("id").orderBy("n", "gram", "place")
    return sized_join(grams, freq, "gram").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.col("size") - (q - 1) - shared + 1).drop("_k", "n")


def candidates(left: DataFrame, right: DataFrame, least: float, own: bool = False) -> DataFrame:
    """(a, b) of texts (id, text) that may have a ratio of ``least`` or more, each pair once. ``own``: both are one table, and only pairs a < b count."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    sized = lambda x: x.select("id", "text", F.char_length("text").alias("size")).filter("size > 0")
    left, right = sized(left), sized(right)
    from_ = first_bigrams(least)
    to = math.floor(from_ * (2 - least) / least) + 1 if from_ < 1 << 30 else 1 << 30
    found = left.select(F.col("id").alias("a"), "text").join(right.select(F.col("id").alias("b"), "text"), "text").select("a", "b")
    if own:
        found = found.filter("a < b")
    for q, keep in ((1, F.col("size") <= to), (2, F.col("size") >= from_)):
        if q == 2 and from_ == 1 << 30:
            continue
        x, y = (_indexed(t.filter(keep), q) for t in (left, right))
        freq = durable((x if own else x.unionByName(y)).groupBy("gram").agg(F.count("*").alias("n")))
        x, y = _rarest(x, freq, q, least), _rarest(y, freq, q, least)
        x = durable(x.select(F.col("id").alias("a"), F.col("size").alias("sa"), "gram", F.col("place").alias("pa")))
        y = x.select(F.col("a").alias("b"), F.col("sa").alias("sb"), "gram", F.col("pa").alias("pb")) if own else durable(y.select(F.col("id").alias("b"), F.col("size").alias("sb"), "gram", F.col("place").alias("pb")))
        met = keyed_pairs(x, y, "gram", "a", "b")
        s = F.col("sa") + F.col("sb")
        m = F.greatest(F.lit(1), F.ceil(s * F.lit(least / 2) - 1e-9))
        met = met.filter((m <= F.least("sa", "sb")) & (F.abs(F.col("pa") - F.col("pb")) <= F.greatest("sa", "sb") - m))
        found = found.unionByName((met.filter("a < b") if own else met).select("a", "b"))
    return found.distinct()


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text; letters are taken modulo 64, which can only raise what two texts share."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & 63
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * 64 + raw, minlength=64 * len(texts)).reshape(len(texts), 64)


def scored(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of pairs (a, b, a_text, b_text) whose ratio, a's text before b's, is at least ``least``."""
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            shared = np.minimum(_letters(x), _letters(y)).sum(axis=1)
            size = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            at, score, m = [], [], SequenceMatcher(None, "", "")
            for i in np.flatnonzero(2 * shared >= least * size - 1e-9).tolist():
                if x[i] == y[i]:
                    r = 1.0
                else:
                    if m.b != y[i]:
                        m.set_seq2(y[i])
                    m.set_seq1(x[i])
                    r = m.ratio()
                if r >= least:
                    at.append(i)
                    score.append(r)
            keep = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(score, pa.float64())], names=["a", "b", "score"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, f"a {types['a']}, b {types['b']}, score double")


def alike(left: DataFrame, right: DataFrame, least: float, own: bool = False) -> DataFrame:
    """(a, b, score) of texts (id, text; one row an id, durable) at a ratio of ``least`` or more. ``own``: pairs a < b of one table, the later text first in the ratio."""
    pairs = candidates(left, right, least, own)
    first, second = ("b", "a") if own else ("a", "b")
    texts = lambda t, c: t.select(F.col("id").alias(c), F.col("text").alias("a_text" if c == first else "b_text"))
    pairs = sized_join(sized_join(pairs, texts(left, "a"), "a"), texts(right, "b"), "b")
    return scored(pairs.select(F.col(first).alias("a"), F.col(second).alias("b"), "a_text", "b_text"), least).select(F.col("a").alias(first), F.col("b").alias(second), "score").select("a", "b", "score")


def _first_heads(titles: DataFrame, least: float) -> DataFrame:
    """(id, head) of a bounded number of titles (id, text), one after the other in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        heads: list[tuple[int, str]] = []
        out = []
        for i, t in rows:
            m = SequenceMatcher(None, "", "")
            m.set_seq1(t)
            hit = None
            for h, text in heads:
                if 2 * min(len(text), len(t)) < least * (len(text) + len(t)):
                    continue
                m.set_seq2(text)
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and _ratio(t, text) >= least:
                    hit = h
                    break
            if hit is None:
                heads.append((i, t))
            out.append((i, i if hit is None else hit))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["id", "head"])

    return titles.select("id", "text").coalesce(1).mapInArrow(run, "id long, head long")


def greedy_heads(titles: DataFrame, least: float, at_once: int = 1024) -> DataFrame:
    """(id, head) of distinct titles (id long in their order, text; durable): each takes the first earlier head that it is alike to, and is a head if there is none.

    The first ``at_once`` titles are settled one after the other and their groups taken away, so that large groups need no pairs. The rest is settled in rounds over the pairs that are alike: a title
    with no earlier open title alike to it is a head, those alike to a head are not. That is the same order of decisions, only many at once.
    """
    start = durable(titles.orderBy("id").limit(at_once))
    done = durable(_first_heads(start, least))
    last = start.agg(F.max("id").alias("m")).first().m
    rest = durable(titles.filter(F.col("id") > last)) if last is not None else titles.limit(0)
    if rest.isEmpty():
        return done
    heads = durable(start.join(done.filter("id = head").select("id"), "id"))
    taken = durable(alike(rest, heads, least).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("head")))
    rest = durable(sized_join(rest, taken, "id", "left_anti"))
    edges = durable(alike(rest, rest, least, own=True).select("a", "b"))  # a is the earlier one
    covered, open_ = None, edges
    while not open_.isEmpty():
        later = durable(open_.select(F.col("b").alias("id")).distinct())
        first = durable(sized_join(open_.select(F.col("a").alias("id")).distinct(), later, "id", "left_anti"))
        hit = durable(sized_join(open_, first.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        covered = hit if covered is None else covered.unionByName(hit)
        gone = durable(first.unionByName(hit))
        open_ = durable(sized_join(sized_join(open_, gone.withColumnRenamed("id", "a"), "a", "left_anti"), hit.withColumnRenamed("id", "b"), "b", "left_anti"))
    if covered is None:
        return done.unionByName(taken).unionByName(rest.select("id", F.col("id").alias("head")))
    covered = durable(covered)
    own = durable(sized_join(rest.select("id"), covered, "id", "left_anti"))
    of = sized_join(edges, own.withColumnRenamed("id", "a"), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("head"))
    return done.unionByName(taken).unionByName(own.select("id", F.col("id").alias("head"))).unionByName(of)


def group_similar(rows: DataFrame, key_col: str, title_col: str, least: float = 0.86, at_once: int = 1024) -> DataFrame:
    """Greedy groups of like titles in key order: (key, title, group_id), a group's id being its first title.

    The first group whose first title is alike takes a title; blank titles form the group 'unknown'.
    """
    norm = F.trim(F.regexp_replace(F.lower(F.col(title_col)), "[^a-z0-9]+", " "))
    named = rows.select(key_col, title_col, F.when(F.coalesce(norm, F.lit("")) != "", norm).alias("_norm"))
    titles = numbered(durable(named.filter("_norm is not null").groupBy("_norm").agg(F.min(key_col).alias("_first"))), ["_first", "_norm"])
    texts = durable(titles.select("id", F.col("_norm").alias("text")))
    heads = sized_join(durable(greedy_heads(texts, least, at_once)), texts, "id").select(F.col("text").alias("_norm"), F.col("head").alias("id"))
    groups = durable(sized_join(heads, texts, "id").select("_norm", F.col("text").alias("group_id")))
    return sized_join(named, groups, "_norm", "left").select(key_col, title_col, F.coalesce("group_id", F.lit("unknown")).alias("group_id"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (durable) with id, their number in order from 0: range partitions are counted, and each adds what lies before it."""
    sorted_ = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted_.groupBy("_part").count()
    before = durable(counts.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sized_join(sorted_, before, "_part").withColumn("id", F.col("_before") + within - 1).drop("_part", "_before")


def best_match(left: DataFrame, names: DataFrame, left_col: str, name_col: str, least: float = 0.78) -> DataFrame:
    """(left, match, score): each distinct left value with the name most like it at or above ``least``, regardless of case; ties go to the smaller name."""
    texts = lambda x, c: durable(x.select(F.col(c).alias("name")).filter("name is not null").distinct().withColumns({"text": F.lower("name"), "id": F.xxhash64("name")}))
    a, b = texts(left, left_col), texts(names, name_col)
    if a.select("id").distinct().count() < a.count() or b.select("id").distinct().count() < b.count():  # two names of one hash: number them instead
        a, b = (durable(numbered(x.drop("id"), ["name"])) for x in (a, b))
    found = alike(a, b, least)
    found = sized_join(sized_join(found, a.select(F.col("id").alias("a"), F.col("name").alias(left_col)), "a"), b.select(F.col("id").alias("b"), F.col("name").alias("match")), "b")
    return found.groupBy(left_col).agg(F.min_by("match", F.struct(-F.col("score"), F.col("match"))).alias("match"), F.max("score").alias("score"))
