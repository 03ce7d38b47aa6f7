import pytest
from conftest import same_rows

import __spark_entry__ as entry
from gaugeweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, spark, sf, duck):
    same_rows(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fuzzy_queries_equal_brute_force(spark, sf):
    """Similarity groups and best matches by plain loops over the standard library's ratio."""
    from difflib import SequenceMatcher

    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()
    first: dict = {}
    for r in sorted(parts):
        first.setdefault(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (r.p_name or "").lower()).split()), r.p_partkey)
    heads, group = [], {"": "unknown"}
    for norm in sorted((n for n in first if n), key=first.get):
        group[norm] = next((h for h in heads if h == norm or ratio(norm, h) >= 0.86), norm)
        heads += [norm] * (group[norm] == norm)
    norm_of = {r.p_partkey: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (r.p_name or "").lower()).split()) for r in parts}
    got = catalog.QUERIES["similarity_groups"](spark, sf).collect()
    assert len(got) == len(parts) and all(r.group_id == group[norm_of[r.p_partkey]] for r in got)
    segments = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_mktsegment").distinct().collect()}
    regions = [r[0] for r in spark.read.parquet(f"{sf}/region.parquet").select("r_name").collect()]
    want = {}
    for s in segments:
        score, name = max(((1.0 if s.lower() == n.lower() else ratio(s.lower(), n.lower()), n) for n in regions), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if score >= 0.3:
            want[s] = (name, score)
    assert {r.c_mktsegment: (r.match, r.score) for r in catalog.QUERIES["fuzzy_best_match"](spark, sf).collect()} == want


def test_places_in_order_equal_sorting(spark):
    import random

    from gaugeweave.operators import geometry

    r = random.Random(2)
    rows = [(k, float(r.choice([r.randint(0, 5), r.random() * 1000]))) for k in range(4) for _ in range((1, 2, 50, 5000)[k])] + [(9, None)]
    got = geometry.at_shares(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.97}, accuracy=100).collect()
    assert len(got) == 4
    for x in got:
        s = sorted(v for k, v in rows if k == x.k)
        assert (x.n, x.low, x.high, x.a, x.b, x.c) == (len(s), s[0], s[-1], s[0], s[len(s) // 2], s[int(len(s) * 0.97)])


def _with_large_keys(spark, sf, path, name, **keys):
    """A table of the smallest size with its keys moved up by so much, in a folder of its own."""
    t = spark.read.parquet(f"{sf}/{name}.parquet")
    t.selectExpr(*(f"{c} + {keys[c]}L as {c}" if c in keys else c for c in t.columns)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_drawn_tables_hold_keys_of_any_size(spark, sf, tmp_path):
    d = _with_large_keys(spark, sf, tmp_path, "orders", o_orderkey=1_000_000_000_000, o_custkey=1_000_000_000_000)
    rows = catalog.QUERIES["test_data_by_category"](spark, d).collect()
    assert rows and all(r.value == str(r.doc_id) for r in rows)
    o = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
    assert {r.doc_id: r.seen for r in catalog.QUERIES["calibration_rows"](spark, d).collect()} == {k: str(c) for k, c in o.items()}
