"""Report text to facts: pages, sections, ASCII tables, key/value pairs, acceptance tests.

Lines come as (doc_id, line_no, text). Markers are carried forward by windows over a document, tables are islands of
consecutive table lines, so documents of any number are parsed in parallel without Python.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import scalars as S
from gaugeweave.shared import durable

PAGE = r"^=== Page ([0-9]+) ===\s*$"
SECTION = r"^\[([^\]]+)\]\s*$"
BORDER = r"^\s*\+[-=+]+\+\s*$"
ROW = r"^\s*\|.*\|\s*$"


def marked_lines(lines: DataFrame) -> DataFrame:
    """Lines with page, section (the last [Section] on the page) and kind: page, section, border, row or text."""
    doc = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = F.nullif(F.regexp_extract("text", PAGE, 1), F.lit("")).cast("int")
    kind = F.when(F.col("text").rlike(PAGE), "page").when(F.col("text").rlike(BORDER), "border").when(F.col("text").rlike(ROW), "row").when(F.col("text").rlike(SECTION), "section").otherwise("text")
    out = lines.withColumns({"page": F.last(page, ignorenulls=True).over(doc), "kind": kind})
    on_page = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("section", F.last(F.when(F.col("kind") == "section", F.regexp_extract("text", SECTION, 1)), ignorenulls=True).over(on_page))


def table_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row_no, cells, label): rows of ASCII tables; a [TABLE_LABEL] line's next line labels the first table after it only."""
    marked = marked_lines(lines)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    inside = F.col("kind").isin("border", "row")
    starts = inside & ~F.coalesce(F.lag("kind").over(w).isin("border", "row"), F.lit(False))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumns({"_in": inside, "_start": starts, "_label": F.when(F.lag("text").over(w) == "[TABLE_LABEL]", F.trim("text"))})
    numbered = numbered.withColumns({"table_no": F.sum(F.when(F.col("_start"), 1).otherwise(0)).over(before), "label_line": F.last(F.when(F.col("_label").isNotNull(), F.col("line_no")), ignorenulls=True).over(before), "label": F.last("_label", ignorenulls=True).over(before)})
    rows = numbered.filter(F.col("_in") & (F.col("kind") == "row"))
    first = F.min("table_no").over(Window.partitionBy("doc_id", "label_line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("doc_id", "page", "table_no", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("line_no")).alias("row_no"), cells.alias("cells"), F.when(F.col("label_line").isNotNull() & (F.col("table_no") == first), F.col("label")).alias("label"))


def key_values(lines: DataFrame, least_gap: int = 8) -> DataFrame:
    """(doc_id, term, value, page, section, line_no): 'a | b' or wide-gap lines outside tables, each pair once on a page."""
    marked = marked_lines(lines).filter("kind = 'text'")
    gap = rf"^\s*(\S.*?)(?:\s{{{least_gap},}}|\s+\|\s+)(\S.*?)\s*$"
    pairs = marked.select("doc_id", "page", "section", "line_no", F.regexp_extract("text", gap, 1).alias("term"), F.regexp_extract("text", gap, 2).alias("value"))
    good = pairs.filter((F.col("term") != "") & F.col("term").rlike(r"\p{L}") & (F.length("term") <= 120) & (F.length("value") <= 200) & ~F.coalesce(F.lower("section").isin("header", "footer"), F.lit(False)))
    w = Window.partitionBy("doc_id", "term", "value", "page").orderBy("line_no")
    return good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Headings of each column role of an acceptance table.
ROLES = {
    "term": ["term", "tag", "parameter", "id", "field", "label", "test"],
    "description": ["description", "desc", "name", "kpi", "metric"],
    "value": ["measured", "measured value", "measured_value", "actual", "value", "reading"],
    "min": ["min", "minimum", "lower", "low", "range min", "range_min", "range (min)"],
    "max": ["max", "maximum", "upper", "high", "range max", "range_max", "range (max)"],
    "units": ["units", "unit", "uom"],
    "requirement": ["requirement", "criteria", "spec", "acceptance", "limit", "target", "threshold"],
    "status": ["status", "result", "pass?", "pass fail", "pass/fail", "outcome"],
}


def _role_of(roles: dict[str, list[str]], least: float):
    """A column function of headings: the role of the synonym most like the heading's words, the first role on ties; null below ``least``."""
    plain = lambda x: " ".join(re.sub("[^a-z0-9]+", " ", x.lower()).split())
    words = [(plain(w), r) for r, ws in roles.items() for w in ws]

    def role(heading: str) -> str | None:
        h, best, found = plain(heading), 0.0, None
        for w, r in words if h else []:
            score = 1.0 if h == w else SequenceMatcher(None, h, w).ratio()
            if score > best:
                best, found = score, r
        return found if best >= least else None

    @F.pandas_udf("string")
    def run(headings: pd.Series) -> pd.Series:
        known = {h: role(h or "") for h in headings.unique()}  # headings repeat
        return headings.map(known)

    return run


def column_roles(rows: DataFrame, roles: dict[str, list[str]] | None = None, least: float = 0.82) -> DataFrame:
    """(doc_id, table_no, at_term, at_description, ...): the 1-based column of each role in each table's first row, the first of several; null where there is none.

    A column headed 'result' of which three fifths are numbers holds the values, if no other does.
    """
    roles = roles or ROLES
    head = rows.filter("row_no = 1").select("doc_id", "table_no", F.posexplode("cells").alias("_c", "_h")).withColumn("_role", _role_of(roles, least)(F.col("_h")))
    first = [F.min(F.when(F.col("_role") == r, F.col("_c") + 1)).alias(f"at_{r}") for r in roles]
    said = F.min(F.when(F.col("_role") == "status", F.struct("_c", F.contains(F.lower("_h"), F.lit("result")).alias("r")))).getField("r").alias("_says_result")
    at = head.groupBy("doc_id", "table_no").agg(*first, said)
    cell = S.blank_to_null(F.try_element_at("cells", F.col("at_status")))
    share = rows.filter("row_no > 1").join(at.filter("at_value is null and _says_result"), ["doc_id", "table_no"]).groupBy("doc_id", "table_no").agg((F.count(S.measured_value(cell)["value"]) / F.count(cell)).alias("_share"))
    moved = F.coalesce(F.col("_share") >= 0.6, F.lit(False))
    out = at.join(share, ["doc_id", "table_no"], "left").withColumn("_moved", moved)
    out = out.withColumn("at_value", F.when(F.col("_moved"), F.col("at_status")).otherwise(F.col("at_value"))).withColumn("at_status", F.when(~F.col("_moved"), F.col("at_status")))
    return out.drop("_says_result", "_share", "_moved")


def acceptance_tests(lines: DataFrame, roles: dict[str, list[str]] | None = None, least: float = 0.82) -> DataFrame:
    """(doc_id, page, table_no, row_no, label, term, description, requirement_raw, requirement_type/min/max, measured_raw, measured_value, measured_note, units, result, computed_pass) of acceptance tables.

    Such a table has a term column, a requirement, value or limit column, and a sign of acceptance: a requirement, limits, units, a status, or a label that
    says so. Two columns of Field and Value are metadata. Without a requirement the limits are one.
    """
    rows = durable(table_rows(lines))  # read four times below
    labels = rows.groupBy("doc_id", "table_no").agg(F.first("label", ignorenulls=True).alias("_label"), F.max(F.when(F.col("row_no") == 1, F.size("cells"))).alias("_width"), F.first(F.when(F.col("row_no") == 1, F.col("cells")), ignorenulls=True).alias("_heads"))
    at = column_roles(rows, roles, least).join(labels, ["doc_id", "table_no"])
    has = lambda *names: F.coalesce(*(F.col(f"at_{n}") for n in names)).isNotNull()
    hint = F.coalesce(F.lower("_label").rlike("accept|criteria|require|spec"), F.lit(False))
    heading = lambda r: F.lower(F.try_element_at("_heads", F.col(f"at_{r}")))
    field_value = (F.col("_width") <= 2) & F.coalesce(F.contains(heading("term"), F.lit("field")) & F.contains(heading("value"), F.lit("value")), F.lit(False))
    at = at.filter(has("term") & has("requirement", "value", "min", "max") & (has("requirement", "min", "max", "units", "status") | hint) & (~field_value | hint))
    at = at.withColumn("at_description", F.coalesce("at_description", F.lit(2)))
    body = rows.filter("row_no > 1").join(at.drop("_label", "_width", "_heads"), ["doc_id", "table_no"])
    cell = lambda r: S.blank_to_null(F.try_element_at("cells", F.col(f"at_{r}")))
    out = body.select("doc_id", "page", "table_no", "row_no", "label", *[cell(r).alias(r) for r in ROLES]).filter("term is not null")
    limits = F.when(F.col("min").isNotNull() & F.col("max").isNotNull(), F.concat_ws(" - ", "min", "max")).when(F.col("min").isNotNull(), F.concat(F.lit(">= "), "min")).when(F.col("max").isNotNull(), F.concat(F.lit("<= "), "max"))
    out = out.withColumn("requirement", F.coalesce("requirement", limits))
    out = out.withColumns({"_req": S.requirement(F.coalesce("requirement", F.lit(""))), "_val": S.measured_value(F.col("value"))})
    return out.select("doc_id", "page", "table_no", "row_no", "label", "term", "description", F.col("requirement").alias("requirement_raw"), F.col("_req.type").alias("requirement_type"), F.col("_req.min").alias("requirement_min"), F.col("_req.max").alias("requirement_max"), F.col("value").alias("measured_raw"), F.col("_val.value").alias("measured_value"), F.col("_val.note").alias("measured_note"), "units", F.col("status").alias("result"), S.passes(F.col("_req"), F.col("_val.value")).alias("computed_pass"))


#: Field names of a document's profile and the columns they fill.
PROFILE = {"PROGRAM": "program", "SERIAL": "serial", "TITLE": "title", "REV": "revision", "TEST DATE": "test_date", "REPORT DATE": "report_date", "OPERATOR": "operator", "FACILITY": "facility", "VALVE MODEL": "valve_model", "VALVE SIZE": "valve_size", "VALVE RATING": "valve_rating", "TEST OPERATOR": "operator"}


def document_profile(lines: DataFrame, pages: int = 2) -> DataFrame:
    """(doc_id, program, serial, ...): what Field/Value tables on the first pages say of a document; the last of several rows counts."""
    rows = table_rows(lines).filter(F.col("page") <= pages)
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    head = rows.filter("row_no = 1").select("doc_id", "table_no", F.array_position(low, "field").cast("int").alias("_f"), F.array_position(low, "value").cast("int").alias("_v")).filter("_f > 0 and _v > 0")
    body = rows.filter("row_no > 1").join(head, ["doc_id", "table_no"]).filter(F.size("cells") >= F.greatest("_f", "_v"))
    named = body.select("doc_id", F.upper(F.trim(F.element_at("cells", F.col("_f")))).alias("_name"), F.trim(F.element_at("cells", F.col("_v"))).alias("_value"), F.struct("table_no", "row_no").alias("_at"))
    column = F.create_map(*[F.lit(x) for k, v in PROFILE.items() for x in (k, v)])[F.col("_name")]
    last = [F.max_by("_value", F.when(column == c, F.col("_at"))).alias(c) for c in dict.fromkeys(PROFILE.values())]
    return lines.select("doc_id").distinct().join(named.groupBy("doc_id").agg(*last), "doc_id", "left")


def calibrations(lines: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row_no, cells): rows of tables labelled as calibration or headed 'as-found' or 'as-left', as maps from heading to text."""
    rows = table_rows(lines)
    label = F.first("label", ignorenulls=True).over(Window.partitionBy("doc_id", "table_no"))
    heads = F.first(F.when(F.col("row_no") == 1, F.col("cells")), ignorenulls=True).over(Window.partitionBy("doc_id", "table_no"))
    rows = rows.withColumns({"_label": label, "_heads": heads})
    fits = F.contains(F.lower(F.coalesce("_label", F.lit(""))), F.lit("calibration")) | F.exists("_heads", lambda h: F.lower(F.trim(h)).isin("as-found", "as-left"))
    n = F.least(F.size("_heads"), F.size("cells"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.try_element_at("_heads", i).alias("key"), F.try_element_at("cells", i).alias("value")))
    return rows.filter((F.col("row_no") > 1) & fits & (n > 0)).select("doc_id", "page", "table_no", "row_no", pairs.alias("cells"))


def extracted(lines: DataFrame) -> dict[str, DataFrame]:
    """All facts of reports: documents, acceptance tests, key/value pairs, test data by category, calibrations."""
    tables = table_rows(lines)
    titled = categories(tables.filter("row_no > 1").withColumn("title", F.coalesce("label", F.lit(""))), "title")
    return {"documents": document_profile(lines), "acceptance_tests": acceptance_tests(lines), "kv_pairs": key_values(lines), "test_data": titled, "calibration": calibrations(lines)}


#: Title words of the measurement categories.
CATEGORIES = [("step_test", ["step", "pressure", "flow"]), ("leak_test", ["leak"]), ("stroke_test", ["cycle", "stroke"]), ("raw_data", ["excerpt", "raw"]), ("inspection", ["seal", "visual", "inspection"])]


def categories(rows: DataFrame, title: str) -> DataFrame:
    """The first category whose word stands in the title; 'other' if none."""
    c = F.lit("other")
    for name, words in reversed(CATEGORIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(title), F.lit(w))
        c = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(c)
    return rows.withColumn("category", c)


def cascade(candidates: DataFrame, key: list[str], priority: str = "priority", value: str = "value") -> DataFrame:
    """The value of the most trusted source that has one: key, value, source priority."""
    return candidates.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, priority).alias(value), F.min(priority).alias(priority))


def line_values(lines: DataFrame, terms: DataFrame, anchor: str = "", want: str = "number") -> DataFrame:
    """(doc_id, term, value): what follows a term in the first line that begins with it, from the anchor line on.

    ``want`` is number (the first one behind the term, else that of the next line) or string (behind a colon or dash, if there is one).
    Terms are equi-joined: a line offers its first words as keys, as many as there are in any term.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("_next", F.lead("text").over(order)).filter(~F.col("text").rlike(ROW) & ~F.col("text").rlike(BORDER))  # tables have their own extractors
    if anchor:
        w = order.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_on", F.max(F.contains(F.lower("text"), F.lit(anchor.lower())).cast("int")).over(w)).filter("_on = 1")
    named = terms.select("term", S.alnum_spaces(F.col("term")).alias("key")).filter("key <> ''").distinct()
    sizes = [r[0] for r in named.select(F.size(F.split("key", " ")).alias("n")).distinct().collect()] or [1]
    words = F.split(S.alnum_spaces(F.col("text")), " ")
    keys = rows.withColumn("_w", words).withColumn("key", F.explode(F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.size("_w")), lambda n: F.array_join(F.slice("_w", F.lit(1), n), " "))))
    behind = F.regexp_replace("text", F.concat(F.lit("(?i)^[^a-z0-9]*"), F.replace(F.col("key"), F.lit(" "), F.lit("[^a-z0-9]+"))), F.lit(""))
    if want == "number":
        value = F.coalesce(S.first_number(behind), S.first_number(F.col("_next")))
    else:
        part = F.when(F.contains(behind, F.lit(":")), F.regexp_replace(behind, "^[^:]*:", "")).otherwise(F.regexp_replace(behind, "^[^-]*-", ""))
        value = F.substring(S.blank_to_null(F.trim(F.regexp_replace(part, r"\s+", " "))), 1, 200)
    found = keys.join(named, "key").withColumn("value", value).filter("value is not null")
    return found.groupBy("doc_id", "term").agg(F.min_by("value", "line_no").alias("value"))


def header_roles(heads: DataFrame, header: str = "header", roles: dict[str, list[str]] | None = None) -> DataFrame:
    """Headers with role: that of the longest role word they contain, null if none; the first role on ties."""
    words = sorted(((w, r, n) for n, (r, ws) in enumerate((roles or ROLES).items()) for w in ws), key=lambda x: (-len(x[0]), x[2]))
    low, role = S.normalize_header(F.col(header)), F.lit(None).cast("string")
    for w, r, _ in reversed(words):
        role = F.when(F.contains(low, F.lit(w)), r).otherwise(role)
    return heads.withColumn("role", role)
