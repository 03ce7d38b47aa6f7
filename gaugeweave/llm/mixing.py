"""Mixing sources to target weights [native]: temperature mixing.

A source's share p of all tokens becomes a weight p^a (normalised). The exponent a is bisected in [0, 1]: it is the
largest that reaches the target entropy, raised as far as the limit on repetition asks. Without a budget, the largest
source is used exactly once and each other one (p_max/p)^(1-a) times, so no document is left out. With a budget of
tokens, source i is used w_i * budget / tokens_i times. Weights are realised by whole passes over a source and one part
of a pass: documents are dealt into blocks by a keyed hash, each pass permutes a source's blocks by another keyed hash,
and the last pass takes blocks, and in the block at the boundary documents, in order until its tokens are used up.

Only source totals, block totals and one boundary block a source are shuffled, never texts. Blocks are at least
``block_tokens`` and at most about 2^16 in all, so the windows over a source's blocks stay small at any size.

Results for odd input: a null source counts as the source ''; null and empty texts have 0 tokens and come with every
pass of their source; rows with equal doc_id are taken together; an empty table gives no rows; further columns, of any name, are kept
by :func:`mixed_documents` (marks of the same name replace them) and ignored by :func:`mixing_plan`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import durable, sized_join

HALVINGS = 20
PER_PASS = 5  # halvings for one job: it evaluates the 2^5 - 1 exponents that these halvings may ask for
MOST_BLOCKS = 1 << 16


@dataclass(frozen=True)
class Mixing:
    """entropy_ratio: target entropy as a part of that of equal weights. max_repeat: most uses of a source for one of the largest."""

    entropy_ratio: float = 0.9
    max_repeat: float = 2.0
    budget: int | None = None
    block_tokens: int = 1 << 20
    seed: str = "mix"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def _key(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def _doc_columns(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumns({"_source": F.coalesce("source", F.lit("")), "_key": _key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))})


def _block(n_blocks: Column) -> Column:
    return F.expr("cast(conv(substr(_key, 1, 8), 16, 10) as long)") % n_blocks


def exponent(shares: DataFrame, spec: Mixing) -> float:
    """Bisects over ``shares`` (share > 0); each job evaluates all midpoints of the next few halvings in one aggregate."""
    n, p_max = shares.agg(F.count("*"), F.max("share")).first()
    if not n:
        return 1.0
    target, lo, hi = spec.entropy_ratio * math.log(n), 0.0, 1.0

    def too_low(points: list[float]) -> list[bool]:
        """For each exponent, whether a larger one is still asked for or allowed: true below the answer, false above it."""
        a = F.explode(F.array(*map(F.lit, points))).alias("a")
        by = shares.select("share", a).groupBy("a").agg(F.sum(F.pow("share", "a")).alias("z"), F.sum(F.pow("share", "a") * F.ln("share")).alias("s"), F.min("share").alias("least"))
        got = by.select("a", (F.ln("z") - F.col("a") * F.col("s") / F.col("z") >= target) | (F.pow(p_max / F.col("least"), 1 - F.col("a")) > spec.max_repeat)).collect()
        return [x for _, x in sorted(got)]

    if too_low([1.0])[0]:
        return 1.0
    for _ in range(HALVINGS // PER_PASS):
        parts = 1 << PER_PASS
        points = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        below = sum(too_low(points))
        lo, hi = lo + (hi - lo) * below / parts, lo + (hi - lo) * (below + 1) / parts
    return hi


def mixing_tables(docs: DataFrame, spec: Mixing) -> tuple[DataFrame, DataFrame]:
    """Per source: exponent, weight, uses, whole passes, boundary block and key. Per block of a source that has a part of a pass: its rank in it."""
    base = durable(_doc_columns(docs.select("doc_id", "source", "text"), spec.seed).select("_source", "_key", n_tokens(F.col("text")).alias("n_tokens")))
    totals = durable(base.groupBy("_source").agg(F.sum("n_tokens").alias("source_tokens")))
    whole = float(totals.agg(F.sum("source_tokens")).first()[0] or 0)
    shares = totals.filter("source_tokens > 0").select((F.col("source_tokens") / F.lit(whole or 1.0)).alias("share"))
    a = exponent(shares, spec)
    p_max, z = shares.agg(F.max("share"), F.sum(F.pow("share", F.lit(a)))).first()
    share = F.col("source_tokens") / F.lit(whole or 1.0)
    weight = F.when(F.col("source_tokens") > 0, F.pow(share, F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    uses = F.pow(F.lit(p_max or 1.0) / share, F.lit(1 - a)) if spec.budget is None else F.pow(share, F.lit(a)) / F.lit(z or 1.0) * F.lit(float(spec.budget)) / F.col("source_tokens")
    size = max(spec.block_tokens, math.ceil(whole / MOST_BLOCKS))
    sources = totals.select("_source", "source_tokens", F.lit(a).alias("exponent"), weight.alias("weight"), F.when(F.col("source_tokens") > 0, uses).otherwise(1.0).alias("uses"), F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / size)).cast("long").alias("n_blocks"))
    sources = durable(sources.withColumns({"passes": F.floor("uses"), "part_tokens": (F.col("uses") - F.floor("uses")) * F.col("source_tokens")}))

    dealt = sized_join(base, sources.select("_source", "n_blocks", "passes", "part_tokens"), "_source").withColumn("block", _block(F.col("n_blocks")))
    blocks = dealt.groupBy("_source", "block", "passes", "part_tokens").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = blocks.withColumn("block_key", _key(spec.seed, F.col("_source"), (F.col("passes") + 1).cast("string"), F.col("block").cast("string")))
    order = Window.partitionBy("_source").orderBy("block_key", "block")
    blocks = blocks.withColumns({"block_rank": F.row_number().over(order), "before": F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    blocks = durable(blocks.filter("before < part_tokens").withColumn("last_block", F.col("before") + F.col("block_tokens") >= F.col("part_tokens")))
    edge = blocks.filter("last_block").select("_source", "block", "before")
    inside = sized_join(dealt, edge, ["_source", "block"]).groupBy("_source", "_key", "before", "part_tokens").agg(F.sum("n_tokens").alias("n_tokens"))
    run = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("done", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).filter("done < part_tokens").groupBy("_source").agg(F.max("_key").alias("cut_key"))
    sources = durable(sources.join(cut, "_source", "left"))
    return sources, blocks.select("_source", "block", "block_rank", "last_block")


def _placed(rows: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` (_source, _key and others that start with an underscore) once for each use, with pass_no, block, weight, uses and exponent."""
    sources, blocks = tables
    rows = sized_join(rows, sources.drop("source_tokens", "part_tokens"), "_source").withColumn("block", _block(F.col("n_blocks")))
    rows = sized_join(rows, blocks, ["_source", "block"], "left")
    part = F.col("block_rank").isNotNull() & (~F.col("last_block") | (F.col("_key") <= F.col("cut_key")))
    rows = rows.withColumn("_all", (F.col("passes") + F.when(part, 1).otherwise(0)).cast("int")).filter("_all > 0")
    return rows.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("_all"))))


def mixed_documents(docs: DataFrame, spec: Mixing = Mixing(), marks: tuple[str, ...] = ("pass_no", "weight", "uses", "exponent")) -> DataFrame:
    """The rows of ``docs`` once for each use, with its pass_no, and the weight, uses and exponent of its source; ``marks`` names those wanted.

    A column of ``docs`` with the name of a wanted mark gives way to it; all other columns are kept, whatever their names.
    """
    low = {m.lower() for m in marks}
    kept = [c for c in docs.columns if c.lower() not in low]
    whole = _doc_columns(docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), spec.seed)
    placed = _placed(whole.select("_source", "_key", "_row"), mixing_tables(docs, spec))
    return placed.select(*(F.col("_row").getField(c).alias(c) for c in kept), *marks)


def mixing_plan(docs: DataFrame, spec: Mixing = Mixing()) -> DataFrame:
    """(doc_id, source, pass_no, block, order_key, exponent, weight): sorted by pass_no and order_key, a source's rows are its permuted blocks."""
    order = F.concat(_key(spec.seed, F.col("_source"), F.col("pass_no").cast("string"), F.col("block").cast("string")), F.lit(":"), F.col("_key"))
    rows = _doc_columns(docs.select("doc_id", "source"), spec.seed).withColumnsRenamed({"doc_id": "_id", "source": "_given"})
    return _placed(rows, mixing_tables(docs, spec)).select(F.col("_id").alias("doc_id"), F.col("_given").alias("source"), "pass_no", "block", order.alias("order_key"), "exponent", F.round("weight", 9).alias("weight"))


def oracle_sql(spec: Mixing = Mixing(), table: str = "documents", keep: str = "doc_id, source, pass_no, block, md5(concat_ws(':', '{seed}', k_source, pass_no::VARCHAR, block::VARCHAR)) || ':' || k AS order_key, exponent, round(weight, 9) AS weight") -> str:
    """The same in DuckDB: the exponent by a recursive bisection over the list of shares, the rest by plain windows."""
    keep = keep.replace("{seed}", spec.seed)
    return f"""WITH RECURSIVE base AS (SELECT *, coalesce(source, '') AS k_source, md5(concat_ws(':', '{spec.seed}', coalesce(doc_id::VARCHAR, 'null'))) AS k,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS nt FROM {table}),
totals AS (SELECT k_source, sum(nt)::BIGINT AS st FROM base GROUP BY 1),
whole AS (SELECT sum(st)::DOUBLE AS t FROM totals),
ps AS (SELECT list(st / t ORDER BY st) AS ps FROM totals, whole WHERE st > 0),
f AS (SELECT ps, {spec.entropy_ratio} * ln(len(ps)) AS target, list_max(ps) AS pm, list_min(ps) AS pl FROM ps),
start AS (SELECT CASE WHEN len(ps) = 0 OR ps IS NULL OR -list_sum([p * ln(p) for p in ps]) >= target OR 1 > {spec.max_repeat} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo FROM f),
b(step, lo, hi) AS (SELECT 0, lo, 1.0::DOUBLE FROM start UNION ALL
  SELECT step + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      (ln(list_sum([pow(p, (lo + hi) / 2) for p in ps])) - (lo + hi) / 2 * list_sum([pow(p, (lo + hi) / 2) * ln(p) for p in ps]) / list_sum([pow(p, (lo + hi) / 2) for p in ps]) >= target)
      OR pow(pm / pl, 1 - (lo + hi) / 2) > {spec.max_repeat} AS up
    FROM b, f WHERE step < {HALVINGS} AND lo < hi)),
ex AS (SELECT hi AS a FROM b ORDER BY step DESC LIMIT 1),
src AS (SELECT k_source, st, a AS exponent, CASE WHEN st > 0 THEN pow(st / t, a) / list_sum([pow(p, a) for p in ps]) ELSE 0 END AS weight,
  CASE WHEN st > 0 THEN pow(pm / (st / t), 1 - a) ELSE 1.0 END AS uses,
  greatest(1, ceil(st / greatest({spec.block_tokens}, ceil(t / {MOST_BLOCKS}))))::BIGINT AS nb FROM totals, whole, ex, f),
src2 AS (SELECT *, floor(uses)::BIGINT AS passes, (uses - floor(uses)) * st AS part FROM src),
dealt AS (SELECT base.*, exponent, weight, passes, part, ('0x' || substr(k, 1, 8))::BIGINT % nb AS block FROM base JOIN src2 USING (k_source)),
blocks AS (SELECT k_source, block, part, passes, sum(nt) AS bt FROM dealt GROUP BY ALL),
ranked AS (SELECT k_source, block, part, bt, coalesce(sum(bt) OVER (PARTITION BY k_source ORDER BY md5(concat_ws(':', '{spec.seed}', k_source, (passes + 1)::VARCHAR, block::VARCHAR)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks),
taken AS (SELECT *, before + bt >= part AS last_block FROM ranked WHERE before < part),
inside AS (SELECT k_source, k, before, d.part, sum(nt) AS nt FROM dealt d JOIN taken USING (k_source, block) WHERE last_block GROUP BY ALL),
runs AS (SELECT k_source, k, part, before + coalesce(sum(nt) OVER (PARTITION BY k_source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM inside),
cut AS (SELECT k_source, max(k) AS cut_key FROM runs WHERE done < part GROUP BY 1),
uses AS (SELECT d.*, passes + CASE WHEN last_block IS NOT NULL AND (NOT last_block OR k <= cut_key) THEN 1 ELSE 0 END AS n FROM dealt d LEFT JOIN taken USING (k_source, block) LEFT JOIN cut USING (k_source)),
passed AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS pass_no FROM uses)
SELECT {keep} FROM passed"""
