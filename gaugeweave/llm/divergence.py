"""Source divergence audit: how far the word use of a language's sources lies apart, and which terms stand out.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. Each language keeps the V terms that at least
``least_docs`` of its documents hold. A (language, source) group gives a kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N its occurrences of kept
terms; the language as a whole gives q in the same way. All arithmetic is in whole numbers (decimals where longs could overflow).

* ``term``: of each group's terms with p > q, the 50 of largest p - q. Radix select: histograms over ten bits of the value at a time, made where the rows
  are, find the 50th value of each group; if more terms than ``few`` tie there, histograms over the bytes of the term go on. What is left, a bounded number of rows
  a group, is ranked by a window.
* ``pair``: for each other source of the language the sum of abs(p - q) over all kept terms. A term that a group lacks has the group's baseline
  p0 = p(0), so only terms that occur are looked at: V abs(p0 - q0), plus a correction for the terms of either group alone (from running sums over the group's distinct
  p, read at the other's p0), plus one for terms that both hold (an equi-join on the term, in blocks of sources, summed in each task).

Texts are read once and counted in place, in tables of bounded size; shuffled are (language, source, term) counts, once, by (language, term).

Results for odd input: null text, lang and source count as ''; a group without terms, or whose language keeps none, still has its ``pair`` rows (with V = 0 their value is
0); a source alone in its language has none; repeated rows count as documents of their own; ties are ranked by the UTF-8 bytes of the item; an empty table gives no rows;
further columns, of any name, are ignored; texts are used whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import durable, sized_join, text_batches

TERM = re.compile(rb"[a-z\x80-\xff]+")  # on lower-cased UTF-8: bytes.lower() changes A-Z alone
LEAST_DOCS, TOP = 30, 50
DIGIT_BITS, DIGITS = 10, 3  # values are below 2^30
#: Ties at a group's last place that are ranked by a window; more are told apart by their bytes first.
FEW = 1024
#: Sources of a language that meet in one task for a term.
SOURCE_BLOCK = 256


def term_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; several rows for a key."""
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def rows(n: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            terms, of = list(counts), held[lang, source]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([of[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = defaultdict(Counter), defaultdict(Counter), 0
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                terms = TERM.findall(text.encode().lower())
                counts = n[lang, source]
                before = len(counts)
                counts.update(terms)
                held[lang, source].update(set(terms))
                size += len(counts) - before
                if size > flush:
                    yield from rows(n, held)
                    n, held, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(n, held)

    return text_batches(docs).select(*cols).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact for all longs."""
    wide = lambda x: x.cast("decimal(20,0)")
    up, down = wide(count + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + 5 * terms)
    return F.lit(1).cast("long") + F.call_function("div", up, down)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n) of kept terms that the group holds."""
    dealt = term_counts(docs).repartition("lang", "term")  # all that follows is partitioned by a part of its keys
    sums = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    both = sums.withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)})
    return both.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, terms, total, lang_total, p0) of every occurring group."""
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("term").alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return found.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0))


GROUP = ["lang", "source"]


def _settle(rows: DataFrame, bin_: Column, wanted: DataFrame, rising: bool) -> DataFrame:
    """(lang, source, bin, k): in which bin the ``wanted`` k-th row of each group lies, and which place it has there. Groups with fewer rows are left out."""
    counts = rows.groupBy(*GROUP, bin_.alias("bin")).count()
    order = Window.partitionBy(*GROUP).orderBy(F.col("bin") if rising else F.col("bin").desc())
    upto = sized_join(counts.withColumn("upto", F.sum("count").over(order)), wanted, GROUP).filter("upto >= k and upto - count < k")
    return durable(upto.select(*GROUP, "bin", (F.col("k") - F.col("upto") + F.col("count")).alias("k"), "count"))


def largest(rows: DataFrame, top: int = TOP, few: int = FEW) -> DataFrame:
    """The ``top`` rows of each group of ``rows`` (lang, source, item, value; durable, values from 0 to 2^30 - 1), by value and then by the bytes of item, with rank."""
    at = durable(rows.select(*GROUP).distinct().withColumns({"k": F.lit(top).cast("long"), "least": F.lit(0).cast("long")}))
    for level in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - level)
        inside = sized_join(rows, at, GROUP).filter(F.shiftright("value", shift + DIGIT_BITS) == F.shiftright("least", shift + DIGIT_BITS))
        found = _settle(inside, F.shiftright("value", shift).bitwiseAND((1 << DIGIT_BITS) - 1), at.select(*GROUP, "k"), False)
        at = durable(sized_join(at.select(*GROUP, "least"), found, GROUP).select(*GROUP, "k", (F.col("least") + F.shiftleft("bin", shift)).alias("least"), "count"))
    # groups of fewer than ``top`` rows have dropped out of ``at``: all their rows stay
    bounds = at.select(*GROUP, "k", "least", "count", F.lit("").cast("binary").alias("prefix"))
    marked = durable(sized_join(rows, durable(bounds), GROUP, "left").filter("least is null or value >= least").withColumn("tied", F.expr("least is not null and value = least")))
    sure, tied = marked.filter("not tied"), marked.filter("tied")
    done = None
    wanted = durable(bounds.filter(F.col("count") > few))
    while not wanted.isEmpty():  # one more byte of the terms each time
        key = F.encode("item", "UTF-8")
        size = F.octet_length("prefix")
        many = sized_join(tied.select(*GROUP, "item", "value"), wanted, GROUP).filter(key.substr(F.lit(1), size) == F.col("prefix"))
        next_ = F.hex(key.substr(size + 1, F.lit(1)))  # '' where the term ends
        found = _settle(many, next_, wanted.select(*GROUP, "k"), True)
        step = durable(sized_join(wanted.select(*GROUP, "prefix"), found, GROUP).withColumn("prefix", F.concat("prefix", F.unhex("bin"))).withColumn("end", F.col("bin") == "").drop("bin"))
        settled = step.filter((F.col("count") <= few) | F.col("end")).select(*GROUP, "prefix")
        done = settled if done is None else done.unionByName(settled)
        wanted = durable(step.filter((F.col("count") > few) & ~F.col("end")).select(*GROUP, "k", F.col("prefix"), "count"))
    if done is not None:
        upto = durable(done)
        # terms up to the last prefix; those beyond can't be among the wanted ones
        tied = sized_join(tied.drop("prefix"), upto, GROUP, "left").filter(F.col("prefix").isNull() | (F.encode("item", "UTF-8").substr(F.lit(1), F.octet_length("prefix")) <= F.col("prefix")))
    left = sure.select(*GROUP, "item", "value").unionByName(tied.select(*GROUP, "item", "value"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def standing_out(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Part ``term``."""
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    values = sized_join(kept, groups, GROUP).select(*GROUP, F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    return largest(durable(values), top)


def pair_sums(kept: DataFrame, groups: DataFrame, block: int = SOURCE_BLOCK) -> DataFrame:
    """Part ``pair`` without ranks: (lang, source, item, value)."""
    held = durable(sized_join(kept, groups, GROUP).select(*GROUP, "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")))
    side = lambda x, *more: groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"{x}0"), *more)
    # every two groups of a language: as many rows as the result has
    pairs = durable(side("a", "terms").join(side("b"), "lang").filter("a <> b"))
    # sums over a's terms of abs(p - b0): running sums over a's distinct p up to each b0
    values = held.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("at")).agg(F.count("term").alias("m"), F.sum("p").alias("s"))
    asked = pairs.select("lang", "a", F.col("b0").alias("at"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("s"), "b", "a0")
    upto, whole = Window.partitionBy("lang", "a").orderBy("at").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang", "a")
    read = values.withColumns({"b": F.lit(None).cast("string"), "a0": F.lit(None).cast("long")}).unionByName(asked)
    read = read.withColumns({"m_le": F.sum("m").over(upto), "s_le": F.sum("s").over(upto), "m_all": F.sum("m").over(whole), "s_all": F.sum("s").over(whole)}).filter("b is not null")
    alone = read.select("lang", "a", "b", F.expr("(s_all - 2 * s_le) - at * (m_all - 2 * m_le) - m_all * abs(a0 - at)").alias("d"))
    # terms of both: blocks of sources, so that a term of many sources is many small joins
    sizes = durable(groups.groupBy("lang").agg(F.ceil(F.count("source") / F.lit(block)).cast("int").alias("blocks")))
    blocks = sized_join(held, sizes, "lang").withColumn("i", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = blocks.select("lang", "term", F.col("i"), F.explode(every).alias("j"), F.col("source").alias("a"), F.col("p0").alias("a0"), F.col("p").alias("pa"))
    right = blocks.select("lang", "term", F.explode(every).alias("i"), F.col("i").alias("j"), F.col("source").alias("b"), F.col("p0").alias("b0"), F.col("p").alias("pb"))
    both = left.join(right.hint("merge"), ["lang", "term", "i", "j"]).filter("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - b0) - abs(pb - a0) + abs(a0 - b0)")).alias("d"))
    base = pairs.select("lang", "a", "b", F.expr("terms * abs(a0 - b0)").alias("d"))
    turned = lambda x: x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "d")
    both = durable(both)
    parts = base.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("d").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    kept = durable(kept_terms(docs, least_docs))
    groups = durable(groups_of(docs, kept))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = pair_sums(kept, groups).withColumn("rank", F.row_number().over(order))
    found = [x.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", standing_out(kept, groups, top)))]
    return found[0].unionByName(found[1])


def oracle_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {least_docs}),
    langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.total, 0) + 5 * l.v) AS p,
            1 + 1000000000::HUGEINT * (k.lang_n + 5) // (l.lang_total + 5 * l.v) AS q
        FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals s USING (lang, source)
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
