"""Source divergence audit against its SQL and a brute-force reading, with ties and odd input."""

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import same_rows

from gaugeweave.llm import divergence, queries

SCHEMA = "lang string, source string, text string"


def brute(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        mine = {s: counts[l, s] for l, s in counts if l == lang}
        total = Counter()
        for c in mine.values():
            total.update(c)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        of, q = {s: p(c) for s, c in mine.items()}, p(total)
        pairs = [(sum(abs(of[source][t] - of[s][t]) for t in kept), s) for s in mine if s != source]
        terms = [(of[source][t] - q[t], t) for t in kept if mine[source][t] > 0 and of[source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def some_rows(seed, n, words=60, sources=7):
    r = random.Random(seed)
    names = [w + x for w in ("the", "été", "漢字", "Zz", "a") for x in ("", "Q", "é", "b", "bb", "c")] + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(words)]
    return [(r.choice(["en", "fr", "", None]), f"s{min(r.randrange(sources), r.randrange(sources))}" if r.random() < 0.9 else None, " ".join(r.choice(names[: 3 + r.randrange(len(names))]) for _ in range(r.randrange(30))) if r.random() < 0.95 else None) for _ in range(n)]


@pytest.mark.parametrize(("least", "top"), [(1, 50), (5, 3), (30, 50), (10_000, 50)])
def test_equals_brute_force(spark, least, top):
    rows = some_rows(least, 400) + [("solo", "one", "a b c"), ("none", "x", "1 2 3"), ("none", "y", None), ("q", "x", "Tie tie TIE"), ("q", "y", "")]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as term", "2 as N", "3 as item").repartition(5), least, top)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_ties_by_bytes_beyond_a_few(spark):
    r = random.Random(3)
    items = sorted({"".join(r.choice("abé漢") for _ in range(r.randrange(1, 9))) for _ in range(700)})
    rows = [("l", "s", x, 7) for x in items] + [("l", "s", "high", 9), ("l", "t", "b", 2**30 - 1), ("l", "u", "low", 0)] + [("l", "u", x, 3 + i % 2) for i, x in enumerate(items[:90])]
    table = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    for few in (1, 20, 5000):
        got = sorted((x.source, x.rank, x.item, x.value) for x in divergence.largest(table, 50, few).collect())
        want = []
        for s in "stu":
            mine = sorted(((-v, i.encode(), i) for _, g, i, v in rows if g == s))[:50]
            want += [(s, k + 1, i, -v) for k, (v, _, i) in enumerate(mine)]
        assert got == sorted(want), few


def test_blocks_of_sources_change_nothing(spark, monkeypatch):
    rows = some_rows(9, 300, sources=20)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = divergence.durable(divergence.kept_terms(docs, 3))
    groups = divergence.durable(divergence.groups_of(docs, kept))
    one, many = ({tuple(r) for r in divergence.pair_sums(kept, groups, block).collect()} for block in (256, 3))
    assert one == many and one
    flushed = divergence.term_counts(docs, flush=10).groupBy("lang", "source", "term").sum("n", "docs").collect()
    assert {tuple(r) for r in flushed} == {tuple(r) for r in divergence.term_counts(docs).groupBy("lang", "source", "term").sum("n", "docs").collect()}


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    n, total, v = 8 * 10**17, 9 * 10**17, 10**6
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_query_equals_sql_and_empty(spark, sf, duck):
    same_rows(queries.QUERIES["op13_divergence"](spark, sf), duck, queries.ORACLE["op13_divergence"])
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
