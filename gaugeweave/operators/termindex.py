"""Which of many asked terms may stand in which document, without a look at every two: an index of short substrings and of word beginnings.

Every way in which a term can meet a text (:mod:`gaugeweave.operators.values`) needs one of these:

* the term or its label is part of the text: then so is each of its substrings; the one that the fewest texts hold is looked up;
* a cell is part of the term or label: the cell's substring that the fewest terms hold is looked up among those of the terms, and containment is tested;

The substrings of a key are nearly as long as the key (``STEPS``), so that many terms that are alike don't meet in the few short ones they share. Longer ones of texts are kept only if a term has them;

* the words of the term or label cover a share of those of the text (fuzzy scores, headings): words that match begin alike, so at least one of its rarest words does.

So candidates are found by equi-joins and none is lost; scores are computed for them alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.shared import durable, keyed_pairs, sized_join

#: Lengths of indexed substrings: a key is looked up by those of the greatest length that it has.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def key_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def grams(key: Column, n: int) -> Column:
    """All substrings of n characters."""
    return F.when(F.length(key) >= n, F.transform(F.sequence(F.lit(1), F.length(key) - (n - 1)), lambda i: key.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def step_of(key: Column) -> Column:
    """The length of the substrings by which a key is looked up; 0 for an empty one."""
    return F.coalesce(*(F.when(F.length(key) >= n, n) for n in reversed(STEPS)), F.lit(0))


def _hashed(tokens: Column) -> Column:
    """Narrow numbers in place of tokens; two that share one can only add candidates."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def beginnings(text: Column) -> Column:
    """The distinct words of ASCII letters and digits, cut to four letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.concat(F.lit("w:"), w.substr(1, 4))))


def other_signs(text: Column) -> Column:
    """The distinct signs that are neither ASCII letters nor digits nor white space."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[^a-z0-9\s]"), F.lit(0))), lambda c: F.concat(F.lit("c:"), c))


def _names(terms: DataFrame) -> DataFrame:
    """(id, which, name, key) of the term and the label of terms (id, term, label)."""
    each = terms.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("which"), F.col(c).alias("name")) for c in ("term", "label")))).alias("x")).select("id", "x.*")
    return each.filter(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("key", key_of(F.col("name")))


def candidates(cells: DataFrame, lines: DataFrame | None, terms: DataFrame, least_cover: float | None = 0.56) -> DataFrame:
    """(doc, id): the terms that may meet a cell or line of each document.

    ``cells`` and ``lines`` are (doc, text): cells meet terms either way, lines only hold them. ``terms`` is (id, term, label, by_words; durable); those with ``by_words``
    also meet what has ``least_cover`` of the words of their term or label.
    """
    names = durable(_names(terms).withColumn("step", step_of(F.col("key"))))
    sizes = sorted(r.step for r in names.filter("step > 0").select("step").distinct().collect())  # at most len(STEPS)
    signs = not names.filter("key = ''").isEmpty()
    worded = not terms.filter("by_words").isEmpty()
    cells = durable(cells.filter("text is not null").distinct())
    texts = cells if lines is None else cells.unionByName(lines.filter("text is not null"))
    of = [grams(key_of(F.col("text")), n) for n in sizes] + [beginnings(F.col("text"))] * worded + [other_signs(F.col("text"))] * signs
    if not of:
        return cells.select("doc", F.lit(None).cast("long").alias("id")).limit(0)
    tokens = texts.select("doc", F.explode(F.array_distinct(_hashed(F.concat(*of)))).alias("token"))

    # what each name could be looked up by, as (id, which, need, token): it must meet one of its rarest tokens
    parts = [names.filter(F.col("step") == n).select("id", "which", F.lit("gram").alias("kind"), F.lit(1).alias("need"), F.explode(F.array_distinct(_hashed(grams(F.col("key"), n)))).alias("token")) for n in sizes]
    if signs:
        parts.append(names.filter("key = ''").select("id", "which", F.lit("sign").alias("kind"), F.lit(1).alias("need"), F.explode(F.array_distinct(_hashed(other_signs(F.col("name"))))).alias("token")))
    if worded:
        words = names.join(terms.filter("by_words").select("id"), "id", "left_semi").withColumn("words", beginnings(F.col("name")))
        # of n words ceil(cover n) match, in as many beginnings less those that coincide; so does one of any such number of beginnings too many to miss them all
        n = F.size(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))))
        matched = F.ceil(n * F.lit(least_cover) - 1e-9) - n + F.size("words")
        need = F.size("words") - F.greatest(F.lit(1), matched) + 1
        parts.append(words.filter(F.size("words") > 0).select("id", "which", F.lit("word").alias("kind"), need.cast("int").alias("need"), F.explode(_hashed(F.col("words"))).alias("token")))
    probes = durable(reduce(DataFrame.unionByName, parts))
    asked = durable(probes.select("token").distinct())
    held = durable(sized_join(tokens, asked, "token", "left_semi").distinct())
    freq = durable(held.groupBy("token").count())
    order = Window.partitionBy("id", "which", "kind").orderBy("n", "token")
    rare = sized_join(probes, freq, "token", "left").withColumn("n", F.coalesce("count", F.lit(0))).withColumn("k", F.row_number().over(order)).filter("k <= need and n > 0")
    rare = durable(rare.select("id", "token").distinct())
    chosen = durable(rare.select("token").distinct())
    found = keyed_pairs(durable(sized_join(held, chosen, "token", "left_semi")), rare, "token", "doc", "id").select("doc", "id")

    # cells that are part of a name: of their substrings that names have, the one that the fewest have
    whole = durable(names.filter("key <> ''").select("id", "key").distinct())
    longest = whole.agg(F.max(F.length("key")).alias("n")).first().n or 0
    short = cells.select(key_of(F.col("text")).alias("cell")).filter((F.col("cell") != "") & (F.length("cell") <= longest)).distinct().withColumn("step", step_of(F.col("cell")))
    short = durable(short)
    own_sizes = sorted(r.step for r in short.select("step").distinct().collect())
    if not own_sizes:
        return found.distinct()
    own = durable(short.select("cell", F.explode(F.array_distinct(_hashed(reduce(lambda rest, n: F.when(F.col("step") == n, grams(F.col("cell"), n)).otherwise(rest), own_sizes, F.array().cast("array<string>"))))).alias("gram")))
    of_names = whole.select("id", "key", F.explode(F.array_distinct(_hashed(F.concat(*(grams(F.col("key"), n) for n in own_sizes))))).alias("gram"))
    of_names = durable(sized_join(of_names, durable(own.select("gram").distinct()), "gram", "left_semi"))
    counts = durable(of_names.groupBy("gram").count())
    # a cell with a substring that no name has is part of none
    rarest = sized_join(own, counts, "gram", "left").withColumn("n", F.coalesce("count", F.lit(0))).groupBy("cell").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n")).filter("n > 0")
    inside = keyed_pairs(durable(rarest.select("cell", "gram")), of_names, "gram", "cell", "id").filter(F.contains("key", "cell")).select("cell", "id").distinct()
    by_cell = keyed_pairs(cells.select("doc", key_of(F.col("text")).alias("cell")).distinct(), durable(inside), "cell", "doc", "id").select("doc", "id")
    return found.unionByName(by_cell).distinct()
