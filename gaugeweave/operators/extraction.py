"""Types of values, dates, canonical metadata, and tables of criteria paired with tables of measured values.

All built in; tables meet by document and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.functions import scalars as S


def value_type(term: Column, explicit: Column, units: Column, low: Column, high: Column) -> Column:
    """'number' or 'string': as given, else a number where units or limits are, and text for known text terms."""
    given = F.lower(F.trim(explicit))
    text = S.normalize_key(term).rlike("serial|partnumber|revision|date|operator|program|model|title")
    return F.when(given.isin("number", "string"), given).when(text, "string").when((F.coalesce(F.trim(units), F.lit("")) != "") | low.isNotNull() | high.isNotNull(), "number").otherwise("string")


def report_dates(lines: DataFrame, labels: list[str], near: int = 3, top: int = 40) -> DataFrame:
    """(doc_id, report_date): the first date on a line that names a label or within ``near`` lines below it, else the first in the top lines."""
    from pyspark.sql.window import Window

    shown = F.regexp_extract("text", r"(20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]20[0-9]{2})", 1)
    named = F.lower("text").rlike("|".join(x.lower() for x in labels))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumns({"_d": S.iso_date(shown), "_l": F.last(F.when(named, F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rank = F.when(F.col("line_no") - F.col("_l") <= near, F.col("line_no")).when(F.col("line_no") < top, F.col("line_no") + 1_000_000)
    return rows.filter(F.col("_d") != "").withColumn("_r", rank).filter("_r is not null").groupBy("doc_id").agg(F.min_by("_d", "_r").alias("report_date"))


def canonical_metadata(existing: DataFrame, extracted: DataFrame, derived: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Each field from the first source that has it; what none has is 'Unknown'."""
    out = existing.select(key, *fields)
    for n, more in enumerate((extracted, derived)):
        out = out.join(more.select(key, *[F.col(f).alias(f"_{n}_{f}") for f in fields]), key, "full_outer")
    pick = lambda f: F.coalesce(*[F.when(~S.is_missing(F.col(c)), F.col(c)) for c in (f, f"_0_{f}", f"_1_{f}")], F.lit("Unknown")).alias(f)
    return out.select(key, *[pick(f) for f in fields])


def paired_tables(rows: DataFrame, within: int = 4) -> DataFrame:
    """(doc_id, row_no, term, requirement_raw, measured_raw): a table of terms and criteria with the next one of measured values, row by row.

    The measured table is the first of at most ``within`` tables behind; rows beyond the shorter table go.
    """
    heads = rows.filter("row_no = 1").select("doc_id", "table_no", F.transform("cells", lambda c: S.normalize_header(c)).alias("h"))
    at = lambda words: F.array_position(F.transform("h", lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))), F.lit(True))
    heads = heads.select("doc_id", "table_no", at(["criteria", "requirement", "limit"]).alias("at_req"), at(["measured", "actual"]).alias("at_val"))
    a = heads.filter("at_req > 0 and at_val = 0").select("doc_id", F.col("table_no").alias("a"), "at_req")
    b = heads.filter("at_val > 0 and at_req = 0").select("doc_id", F.explode(F.sequence(F.col("table_no") - within, F.col("table_no") - 1)).alias("a"), F.col("table_no").alias("b"), "at_val")
    pairs = a.join(b, ["doc_id", "a"]).groupBy("doc_id", "a", "at_req").agg(F.min(F.struct("b", "at_val")).alias("m")).select("doc_id", "a", "at_req", "m.b", "m.at_val")
    left = rows.filter("row_no > 1").select("doc_id", F.col("table_no").alias("a"), "row_no", F.col("cells").alias("left_cells"))
    right = rows.filter("row_no > 1").select("doc_id", F.col("table_no").alias("b"), "row_no", F.col("cells").alias("right_cells"))
    joined = pairs.join(left, ["doc_id", "a"]).join(right, ["doc_id", "b", "row_no"])
    return joined.select("doc_id", "row_no", F.element_at("left_cells", 1).alias("term"), F.try_element_at("left_cells", F.col("at_req").cast("int")).alias("requirement_raw"), F.try_element_at("right_cells", F.col("at_val").cast("int")).alias("measured_raw"))
