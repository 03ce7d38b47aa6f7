"""The substring index against all pairs, greedy groups against the loop over titles, and joins beyond the broadcast limit."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gaugeweave import shared
from gaugeweave.operators import likeness

ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()


def titles(seed, n):
    r = random.Random(seed)
    stems = ["acceptance test report", "valve", "thruster hot fire data", "é漢 pump", "leak", "x"]
    out = []
    while len(out) < n:
        t = r.choice(stems) + r.choice(["", " ", " rev "]) + "".join(r.choice("ab12") for _ in range(r.randrange(6)))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(t) + 1)
            t = t[:k] + r.choice(["", "q", "zz"]) + t[k + r.randrange(2) :]
        if t.strip() and t not in out:
            out.append(t)
    return out


def frame(spark, texts):
    return shared.durable(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3))


@pytest.mark.parametrize("least", [0.3, 0.67, 0.72, 0.78, 0.86, 0.95, 1.0])
def test_no_pair_is_lost(spark, least):
    a, b = titles(1, 120) + ["a", "ab", "axb", ""], titles(2, 120) + ["a", "ba", "ab", ""]
    got = {(r.a, r.b): r.score for r in likeness.alike(frame(spark, a), frame(spark, b), least).collect()}
    assert got == {(i, j): s for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (s := ratio(x, y)) >= least}
    own = {(r.a, r.b): r.score for r in likeness.alike(frame(spark, a), frame(spark, a), least, own=True).collect()}
    assert own == {(i, j): s for j, y in enumerate(a) for i, x in enumerate(a[:j]) if x and y and (s := ratio(y, x)) >= least}


def test_long_texts_and_popular_letters(spark):
    r = random.Random(5)
    a = ["".join(r.choice("abcdefgh ") for _ in range(260)) for _ in range(4)]
    a += [t[:100] + "x" + t[103:] for t in a]
    got = {(x.a, x.b) for x in likeness.alike(frame(spark, a), frame(spark, a), 0.8, own=True).collect()}
    assert got == {(i, j) for j, y in enumerate(a) for i, x in enumerate(a[:j]) if ratio(y, x) >= 0.8}


def greedy(texts, least):
    heads, out = [], {}
    for i, t in enumerate(texts):
        out[i] = next((h for h in heads if ratio(t, texts[h]) >= least), i)
        heads += [i] * (out[i] == i)
    return out


@pytest.mark.parametrize(("least", "at_once"), [(0.86, 1), (0.86, 40), (0.7, 5), (0.86, 5000)])
def test_groups_equal_the_loop(spark, least, at_once):
    texts = titles(3, 250)
    assert {r.id: r.head for r in likeness.greedy_heads(frame(spark, texts), least, at_once).collect()} == greedy(texts, least)


def test_a_chain_of_titles(spark):
    texts = ["abcdefghij" * 2]
    for k in range(20):  # each is like its neighbours alone
        texts.append(texts[-1][:k] + "Z" + texts[-1][k + 1 :])
    assert {r.id: r.head for r in likeness.greedy_heads(frame(spark, texts), 0.9, 1).collect()} == greedy(texts, 0.9)


def test_group_similar_by_key(spark):
    r = random.Random(7)
    texts = titles(8, 60)
    rows = [(r.randrange(1000), r.choice([*texts, None, "  ", "Valve #1"])) for _ in range(300)]
    norm = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())
    first = {}
    for k, t in rows:
        if norm(t):
            first[norm(t)] = min(first.get(norm(t), k), k)
    order = sorted(first, key=lambda t: (first[t], t))
    heads = greedy(order, 0.86)
    want = sorted((k, t or "", order[heads[order.index(norm(t))]] if norm(t) else "unknown") for k, t in rows)
    for at_once in (3, 1000):
        got = likeness.group_similar(spark.createDataFrame(rows, "k int, t string"), "k", "t", at_once=at_once)
        assert sorted((x.k, x.t or "", x.group_id) for x in got.collect()) == want
    assert likeness.group_similar(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0


def test_best_match_of_many_names(spark):
    names = [f"name {i:05d}" for i in range(300)] + [None, "Dup", "dup"]
    left = ["NAME 00007", "name 0029", "zz", "", None, "DUP", "DUP"]
    frames = spark.createDataFrame([(x,) for x in left], "t string"), spark.createDataFrame([(x,) for x in names], "n string")
    got = {r.t: (r.match, r.score) for r in likeness.best_match(*frames, "t", "n").collect()}
    want = {}
    for t in filter(None, left):
        found = sorted((-ratio(t.lower(), n.lower()), n) for n in names if n and ratio(t.lower(), n.lower()) >= 0.78)
        if found:
            want[t] = (found[0][1], -found[0][0])
    assert got == want and set(got) == {"NAME 00007", "name 0029", "DUP"}
    with pytest.raises(ValueError, match="least"):
        likeness.best_match(*frames, "t", "n", 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right"])
def test_joins_beyond_the_limit(spark, how):
    r = random.Random(1)
    big = spark.createDataFrame([(r.choice([None, *range(400)]), r.choice("ab"), "text" * 5) for _ in range(600)], "k int, _bits string, text string")
    small = shared.durable(spark.createDataFrame([(k, b, k * 2) for k in range(0, 300, 3) for b in "ac"], "k int, _bits string, v int"))
    rows = lambda limit, on: sorted(map(repr, shared.sized_join(big if on != "k" else big.drop("_bits"), small if on != "k" else small.filter("_bits = 'a'").drop("_bits"), on, how, limit).collect()))
    assert rows(10, "k") == rows(10_000, "k") and rows(10, ["k", "_bits"]) == rows(10_000, ["k", "_bits"])


def test_only_possible_partners_shuffle(spark):
    big = spark.range(20_000).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    small = shared.durable(spark.range(0, 20_000, 200))
    words, size = shared.bitmap(small, small.count())
    marked, maybe = shared.may_have(big, ["id"], words, size)
    n = marked.filter(maybe).count()
    assert 100 <= n < 400  # the hundred partners and a few by chance
    assert marked.filter(maybe).join(small, "id", "left_semi").count() == 100


def test_blocks_of_a_common_key(spark):
    a = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1)], "g string, a int")
    b = spark.createDataFrame([("hot", i) for i in range(30)] + [("cold", 7), ("other", 1)], "g string, b int")
    got = sorted(tuple(r) for r in shared.keyed_pairs(a, b, "g", "a", "b", block=8).select("g", "a", "b").collect())
    assert got == sorted([("hot", i, j) for i in range(50) for j in range(30)] + [("cold", 1, 7)])


def test_numbers_in_order(spark):
    rows = [(k % 7, str(k)) for k in range(100)]
    got = likeness.numbered(shared.durable(spark.createDataFrame(rows, "a int, b string")), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.id)] == sorted(rows) and sorted(r.id for r in got) == list(range(100))
