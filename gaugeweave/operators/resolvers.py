"""Metadata of documents from their texts, names, folders and workbook cells.

Allowlists are tables (canonical, alias, acronym). Whole words of a text are looked up by equi-join on runs of words (see
:mod:`.metadata`), so neither the number of documents nor that of names makes a theta join.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import identities as I
from gaugeweave.functions import scalars as S
from gaugeweave.operators import metadata as M
from gaugeweave.shared import durable

#: The fields that metadata may hold, and the labels by which each is found.
FIELDS = ("program_title", "asset_type", "asset_specific_type", "serial_number", "part_number", "revision", "test_date", "report_date", "document_type", "document_type_acronym", "vendor", "acceptance_test_plan_number")
LABELS = {
    "program_title": ["program title", "program name"],
    "asset_type": ["asset type", "component type", "component", "asset"],
    "asset_specific_type": ["asset specific type", "asset model", "model", "valve model", "pump model", "actuator model"],
    "serial_number": ["serial number", "serial no", "serial #", "serial"],
    "part_number": ["part number", "part no", "part no.", "part #", "p/n", "pn", "par tno", "par t no", "par tno."],
    "revision": ["revision", "rev"],
    "test_date": ["test date", "date of test"],
    "report_date": ["report date", "date of report"],
    "vendor": ["vendor", "supplier", "manufacturer", "mfr", "oem"],
    "acceptance_test_plan_number": ["acceptance test plan", "test plan", "acceptance plan", "atp", "plan number"],
}
#: Names of fields that hold a part number.
PART_LABELS = ["part number", "part no", "part #", "p/n", "pn", "par tno", "par t no", "model", "model number", "model no", "model #", "item number", "item no", "item #", "catalog number", "catalog no", "catalog #", "cat no", "cat #", "product number", "product no", "product #", "sku", "stock number", "assembly number", "assy no", "assy #", "valve model", "pump model", "actuator model", "component model", "unit model"]


# configuration
def first_json(spark: SparkSession, paths: list[str], default: dict) -> dict:
    """The first of several JSON files that can be read and is an object, else the default."""
    for path in paths:
        try:
            found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
        except Exception:  # noqa: BLE001  a missing or broken file gives way to the next
            continue
        if isinstance(found, dict):
            return found
    return default


def distinct_texts(values: list) -> list[str]:
    """Trimmed texts without blanks and repeats (whatever the case), in order."""
    out: dict[str, str] = {}
    for v in values:
        text = str(v or "").strip()
        if text:
            out.setdefault(text.casefold(), text)
    return list(out.values())


def merged_labels(given: dict | None) -> dict[str, list[str]]:
    """The labels of each field with those of a configuration behind; unknown fields are dropped."""
    more = {k: v for k, v in (given or {}).items() if k in FIELDS and isinstance(v, list)}
    return {k: distinct_texts([*LABELS.get(k, []), *more.get(k, [])]) for k in dict.fromkeys([*LABELS, *more])}


def merged_part_labels(given: list | None) -> list[str]:
    return distinct_texts([*PART_LABELS, *(given if isinstance(given, list) else [])])


def alias_entries(raw: object, with_acronym: bool = False) -> list[tuple[str, str, list[str]]]:
    """(name, acronym, aliases) of a configured list of texts or objects; objects without name or aliases are dropped, and the name is an alias of itself."""
    out = []
    for item in raw if isinstance(raw, list) else []:
        given = {"name": item, "acronym": item, "aliases": [item]} if isinstance(item, str) else item if isinstance(item, dict) else {}
        aliases = [str(a).strip() for a in given.get("aliases") or [] if str(a).strip()] if isinstance(given.get("aliases") or [], list) else []
        name = str(given.get("name") or "").strip() or next(iter(aliases), "")
        acronym = str(given.get("acronym") or "").strip() or name
        if name:
            out.append((name, acronym if with_acronym else name, distinct_texts([*aliases, name, *([acronym] if with_acronym else [])])))
    return out


def allow_table(spark: SparkSession, raw: object, with_acronym: bool = False) -> DataFrame:
    """(canonical, alias, acronym, place) of a configured list; a document type's canonical form is its acronym."""
    rows = [(acr if with_acronym else name, a, acr, n) for n, (name, acr, aliases) in enumerate(alias_entries(raw, with_acronym)) for a in aliases]
    return spark.createDataFrame(rows, "canonical string, alias string, acronym string, place int")


# texts
def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: S.strip(x)), lambda x: x != "")


def first_pages(text: Column, pages: int = 3, most: int = 800) -> Column:
    """The lines before page ``pages`` + 1, at most ``most`` of them (a limit of the feature: what identifies a document stands on its first pages)."""
    head = F.split(text, rf"(?m)^\s*=== Page {pages + 1} ===", 2)[0]
    return F.array_join(F.slice(lines_of(head), 1, most), "\n")


def _first_pages(text: Column, lines: Column, pages: int = 3, most: int = 800) -> Column:
    """As :func:`first_pages`, of a text whose lines are known: most texts have no page behind."""
    return F.when(F.contains(text, F.lit(f"=== Page {pages + 1} ===")), first_pages(text, pages, most)).otherwise(F.array_join(F.slice(lines, 1, most), "\n"))


def _bar_cells(line: Column) -> Column:
    """The cells of a line with pipes that aren't blank; none of other lines."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(S.strip(line), r"^\|+|\|+$", ""), r"\|"), lambda x: S.strip(x)), lambda x: x != "")
    return F.when(F.contains(line, F.lit("|")), cells).otherwise(F.array().cast("array<string>"))


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed_lines(lines: Column) -> Column:
    """Of each line what labels are looked up in: the line and its lower case, a table row's first cell in lower case and its second, and the next line if it is text."""

    def parsed(line: Column, i: Column) -> Column:
        below = F.get(lines, i + 1)
        next_ = F.when(below.isNotNull() & ~F.startswith(below, F.lit("+")) & ~F.contains(below, F.lit("|")), below)
        return _bind(_bar_cells(line), lambda cells: F.struct(line.alias("line"), F.lower(line).alias("low"), F.lower(F.get(cells, F.lit(0))).alias("key"), F.get(cells, F.lit(1)).alias("second"), next_.alias("next")))

    return F.transform(lines, parsed)


def _tail(line: Column, label: str) -> Column:
    """What stands behind a line's first :, else behind its first -, else the line without the label."""
    behind = F.when(F.contains(line, F.lit(":")), F.regexp_replace(line, "^[^:]*:", "")).when(F.contains(line, F.lit("-")), F.regexp_replace(line, "^[^-]*-", ""))
    return S.strip(F.coalesce(behind, F.regexp_replace(line, f"(?i){re.escape(label)}", "")))


def value_behind(parsed: Column, label: str) -> Column:
    """As :func:`label_value`, in lines that have been parsed."""
    low, word = F.lit(label.lower()), rf"(?i)\b{re.escape(label.lower())}\b"

    def stop(x: Column) -> Column:
        like = (x["key"] == low) | F.contains(x["key"], low) | F.contains(low, x["key"])
        # most lines don't hold the label at all, which is told without a pattern
        said = F.contains(x["low"], low) & x["line"].rlike(word) & (x["next"].isNotNull() | (_tail(x["line"], label) != ""))
        return F.when(x["key"].isNotNull(), like).otherwise(said)

    def value(x: Column) -> Column:
        return F.when(x["key"].isNotNull(), x["second"]).otherwise(F.coalesce(F.nullif(_tail(x["line"], label), F.lit("")), x["next"]))

    return _bind(F.try_element_at(F.filter(parsed, stop), F.lit(1)), value)


def label_value(lines: Column, label: str) -> Column:
    """What stands behind a label: in the second cell of a table row whose first cell is like it, else after : or - on the line that has it, else on the next line."""
    return value_behind(parsed_lines(lines), label)


def first_value(parsed: Column, labels: list[str], low: Column | None = None, keys: Column | None = None) -> Column:
    """The value of the first label that has one, in lines that have been parsed.

    ``low`` (all lines in lower case) and ``keys`` (the rows' first cells in lower case) tell at once which labels no line can hold.
    """

    def of(label: str) -> Column:
        value = F.get(F.filter(F.array(value_behind(parsed, label)), lambda v: v != ""), F.lit(0))
        if low is None:
            return value
        name = F.lit(label.lower())
        return F.when(F.contains(low, name) | F.exists(keys, lambda k: F.contains(name, k)), value)

    return F.coalesce(*map(of, labels)) if labels else F.lit(None).cast("string")


def first_label_value(lines: Column, labels: list[str]) -> Column:
    """The value of the first label that has one."""
    return first_value(parsed_lines(lines), labels)


def program_title(lines: Column) -> Column:
    """The second cell of a row titled so, else of one named by the program, else what follows a line's 'Program' and a : or - (not the program code)."""
    def cell(names: list[str]) -> Column:
        return F.try_element_at(F.filter(F.transform(lines, lambda x: F.struct(F.lower(F.get(_bar_cells(x), F.lit(0))).alias("k"), F.get(_bar_cells(x), F.lit(1)).alias("v"))), lambda c: c.k.isin(*names)), F.lit(1))["v"]

    said = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("program")) & ~F.contains(F.lower(x), F.lit("program code")) & ~F.contains(x, F.lit("|")) & x.rlike("[:-]"))
    after = F.regexp_extract(F.try_element_at(said, F.lit(1)), r"^(?:[^:]*:|[^:-]*-)\s*(.*)$", 1)
    return F.coalesce(cell(["title", "document title"]), cell(["program", "program title", "program name"]), S.strip(after))


def part_number(lines: Column, labels: list[str], most: int = 150) -> Column:
    """The value of the first row whose field is like a part number's name; it has three signs or more and a letter or digit. Header tables stand in the first lines."""
    names = F.array(*map(F.lit, labels))
    cells = F.transform(F.slice(lines, 1, most), _bar_cells)
    fits = F.filter(cells, lambda c: (F.size(c) > 1) & F.exists(names, lambda n: F.contains(F.lower(c[0]), n) | F.contains(n, F.lower(c[0]))) & (F.length(c[1]) >= 3) & c[1].rlike("[A-Za-z0-9]"))
    return F.try_element_at(fits, F.lit(1))[1]


def asset_in_fields(lines: Column, assets: list[str]) -> Column:
    """The first asset type that is part of a row's first cell, rows first."""
    names = F.array(*map(F.lit, assets))
    hits = F.transform(lines, lambda x: F.try_element_at(F.filter(names, lambda n: F.contains(F.lower(F.get(_bar_cells(x), F.lit(0))), F.lower(n))), F.lit(1)))
    return F.try_element_at(F.filter(hits, lambda x: x.isNotNull()), F.lit(1))


def _words(name: str) -> str:
    return rf"(?i)\b{re.escape(name)}\b"


def asset_in_text(text: Column, assets: list[str]) -> Column:
    """The first asset type that stands in a text as whole words."""
    return F.coalesce(*(F.when(text.rlike(_words(a)), a) for a in assets)) if assets else F.lit(None).cast("string")


def asset_in_name(path: Column, assets: list[str]) -> Column:
    """The first asset type that is part of a file's name."""
    return F.coalesce(*(F.when(F.contains(F.lower(I.stem(path)), F.lit(a.lower())), a) for a in assets)) if assets else F.lit(None).cast("string")


def asset_by_frequency(first_page: Column, assets: list[str], least: int = 2) -> Column:
    """The asset type named most on the first page, the earlier one on ties, if it is named at least twice."""
    if not assets:
        return F.lit(None).cast("string")
    counts = F.array(*(F.struct(F.regexp_count(first_page, F.lit(_words(a))).alias("n"), F.lit(-i).alias("o"), F.lit(a).alias("a")) for i, a in enumerate(assets)))
    best = F.array_max(counts)
    return F.when(best.n >= least, best.a)


def exact_candidate(value: Column, candidates: list[str]) -> Column:
    """The first candidate that is the value but for white space and case."""
    return F.coalesce(*(F.when(S.normalize_text(value) == re.sub(r"\s+", " ", c).strip().lower(), c) for c in candidates)) if candidates else F.lit(None).cast("string")


def without_type_lines(lines: Column) -> Column:
    """Lines that don't name the document's type."""
    return F.filter(lines, lambda x: ~F.lower(x).rlike("end[ -]item data package") & ~(F.contains(F.lower(x), F.lit("data package")) & F.contains(F.lower(x), F.lit("eidp"))))


def first_type(text: Column, entries: list[tuple[str, str, list[str]]]) -> Column:
    """The acronym of the first entry of which an alias stands in the text, entries and aliases in order."""
    hits = [F.when(text.rlike(_words(a)), acr) for _, acr, aliases in entries for a in aliases]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def default_type(path: Column, acronyms: list[str]) -> Column:
    """DATA for workbooks and EIDP for others, if such a type is allowed."""
    up = {a.upper(): a for a in reversed(acronyms)}
    want = F.when(F.lower(path).rlike(r"\.(xlsx|xls|xlsm)$"), F.lit(up.get("DATA"))).otherwise(F.lit(up.get("EIDP")))
    return want.cast("string")


def _acronyms(allowed: DataFrame) -> list[str]:
    return [r[0] for r in allowed.groupBy("canonical").agg(F.min("place").alias("p")).orderBy("p").select("canonical").collect()]


def _or_default(found: Column, path: Column, acronyms: list[str]) -> Column:
    return F.when(found == "Unknown", F.coalesce(default_type(path, acronyms), F.lit("Unknown"))).otherwise(found)


def document_types(docs: DataFrame, allowed: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """(key, document_type): the longest alias in the first lines and pages, else in the file's name, else of a folder, else the default if it is allowed, else 'Unknown'."""
    blob = F.concat_ws("\n", F.array_join(F.slice(lines_of(F.col(text)), 1, 60), "\n"), I.stem(F.col(path)), first_pages(F.col(text)))
    found = M.strict_field(docs.select(key, path, blob.alias("_blob")), allowed.select("canonical", "alias"), key, ["_blob"], path)
    both = docs.select(key, path).join(found, key, "left")
    return both.select(key, _or_default(F.col("canonical"), F.col(path), _acronyms(allowed)).alias("document_type"))


STRICT = ("program_title", "vendor", "asset_type", "asset_specific_type", "part_number", "acceptance_test_plan_number")


def text_metadata(docs: DataFrame, allowed: dict[str, DataFrame], labels: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """(key, fields...) of documents (key, path, text): strict fields by allowlist (label's value, first pages, file name, folders), the others by label; 'Unknown' where nothing is found.

    ``allowed`` has a table (canonical, alias, acronym, place) for each strict field; a field without one is 'Unknown'. Where all lists are short, every field is a
    column of its document's row, which stays where it is; long lists are joined.
    """
    labels = labels or LABELS
    used = [f for f in STRICT if f in allowed]
    # each step is read more than once by the next, so it stays a projection of its own and is computed once
    base = docs.select(F.col(key).alias("_key"), F.col(path).alias("_path"), F.col(text).alias("_text"), lines_of(F.col(text)).alias("_lines"))
    base = base.withColumns({"_parsed": parsed_lines(F.col("_lines")), "_low": F.lower(F.array_join("_lines", "\n")), "_pages": _first_pages(F.col("_text"), F.col("_lines"))})
    keys = F.when(F.contains("_low", F.lit("|")), F.filter(F.transform("_parsed", lambda x: x["key"]), lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))
    base = base.withColumn("_keys", keys)
    looked = {f"_{f}": first_value(F.col("_parsed"), labels[f], F.col("_low"), F.col("_keys")) for f in (*used, "revision", "test_date")}
    serial = F.upper(F.regexp_extract(F.array_join(F.slice("_lines", 1, 200), "\n"), r"(?i)\bSN\d+\b", 0))
    top = F.array_join(F.slice("_lines", 1, 60), "\n")
    base = base.select("_key", "_path", "_pages", "_lines", top.alias("_top"), F.nullif(serial, F.lit("")).alias("serial_number"), *(c.alias(n) for n, c in looked.items()))
    plain = {"revision": S.revision(F.col("_revision")), "test_date": found_date(F.col("_test_date")), "report_date": report_date(F.col("_lines"), labels["report_date"])}
    lists = {f: M.short_lists(allowed[f].select("canonical", "alias")) for f in (*used, *(f for f in ("document_type",) if f in allowed))}
    if all(x is not None for x in lists.values()):
        words = {"_name": M.file_name(F.col("_path")), "_stem": I.stem(F.col("_path")), "_pages": F.col("_pages")} | {f"_{f}": F.col(f"_{f}") for f in used}
        out = base.withColumns(plain).withColumns({n: M.words_of(c) for n, c in words.items()} | {"_top": F.when(F.col("_top") == F.col("_pages"), None).otherwise(M.words_of(F.col("_top")))})
        blob = M.spaced_words(F.coalesce("_top", "_pages"), F.col("_stem"), F.col("_pages"))
        out = out.withColumns({n: M.spaced_words(F.col(n)) for n in words} | {"_blob": blob})
        of = lambda f, *texts: M.field_in_place([F.col(t) for t in (*texts, "_name")], F.col("_path"), lists[f])
        out = out.withColumns({f: of(f, f"_{f}", "_pages") if f in allowed else F.lit("Unknown") for f in STRICT})
        if "document_type" in allowed:
            out = out.withColumn("document_type", of("document_type", "_blob"))
            out = out.withColumn("document_type", _or_default(F.col("document_type"), F.col("_path"), _acronyms(allowed["document_type"])))
        else:
            out = out.withColumn("document_type", F.lit("Unknown"))
        out = out.withColumnRenamed("_key", key)
    else:
        found = durable(base.withColumns(plain).drop("_lines", "_top").withColumnRenamed("_key", key))
        out = found.select(key, "serial_number", *plain)
        for f in STRICT:
            if f in allowed:
                got = M.strict_field(found.select(key, "_path", "_pages", f"_{f}"), allowed[f].select("canonical", "alias"), key, [f"_{f}", "_pages"], "_path")
                out = out.join(got.withColumnRenamed("canonical", f), key, "left")
            else:
                out = out.withColumn(f, F.lit("Unknown"))
        if "document_type" in allowed:
            out = out.join(document_types(docs, allowed["document_type"], key, text, path), key, "left")
        else:
            out = out.withColumn("document_type", F.lit("Unknown"))
    out = out.withColumn("document_type_acronym", F.col("document_type"))
    return out.select(key, *(F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("Unknown")).alias(f) for f in FIELDS))


def found_date(c: Column) -> Column:
    """The first date anywhere in a text, as YYYY-MM-DD."""
    return S.iso_date(F.regexp_extract(c, r"(20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]20\d{2})", 1))


def report_date(lines: Column, labels: list[str], near: int = 3, top: int = 40) -> Column:
    """The first date on or within ``near`` lines below a line that names a label, else the first in the top lines."""
    named = "(?i)" + "|".join(map(re.escape, labels))
    dated = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(F.contains(x, F.lit("20")), found_date(x)).alias("d"), x.rlike(named).alias("n")))

    def first(dated: Column) -> Column:
        early = F.filter(F.slice(dated, 1, top), lambda x: x.d.isNotNull())
        if not labels:
            return F.try_element_at(early, F.lit(1))["d"]
        above = lambda i: F.slice(dated, F.greatest(i + 1 - near, F.lit(1)), F.least(i + 1, F.lit(near + 1)))
        near_label = F.filter(dated, lambda x: x.d.isNotNull() & F.exists(above(x.i), lambda y: y.n))
        return F.coalesce(F.try_element_at(near_label, F.lit(1))["d"], F.try_element_at(early, F.lit(1))["d"])

    return _bind(dated, first)


def sheet_metadata(cells: DataFrame, labels: dict[str, list[str]] | None = None, sheets: int = 6, rows: int = 120, cols: int = 30, key: str = "doc_id") -> DataFrame:
    """(key, fields...) of workbook cells (key, sheet_no, row, col, value): the value right of a label, else the one below, the first label in reading order; null where there is none.

    The bounds are those of the feature: labels stand at the top of the first sheets.
    """
    pairs = [(f, " ".join(a.lower().split()).rstrip(":")) for f, names in (labels or LABELS).items() for a in names]
    names = cells.sparkSession.createDataFrame(pairs, "field string, _label string")
    c = cells.filter((F.col("sheet_no") < sheets) & (F.col("row") <= rows) & (F.col("col") <= cols) & (F.trim("value") != ""))
    right = F.lead("value").over(Window.partitionBy(key, "sheet_no", "row").orderBy("col"))
    below = F.lead("value").over(Window.partitionBy(key, "sheet_no", "col").orderBy("row"))
    c = c.withColumns({"_right": right, "_below": below, "_label": F.regexp_replace(S.normalize_text(F.col("value")), r"\s*:$", "")})
    hit = c.join(F.broadcast(names), "_label").withColumn("_v", F.coalesce("_right", "_below")).filter("_v is not null")
    best = hit.groupBy(key, "field").agg(F.min_by(F.trim("_v"), F.struct("sheet_no", "row", "col")).alias("v"))
    wide = best.groupBy(key).pivot("field", list(labels or LABELS)).agg(F.first("v"))
    return cells.select(key).distinct().join(wide, key, "left")


def sanitized(meta: DataFrame, allowed: dict[str, DataFrame], default_type_: str = "EIDP", key: str = "doc_id") -> DataFrame:
    """Only known fields; strict ones become the allowed name in their value, else 'Unknown', as all are without an allowlist. The type may come from the default."""
    have = [f for f in FIELDS if f in meta.columns]
    out = meta.select(key, *have)
    for f in ("program_title", "vendor", "asset_type", "asset_specific_type", "part_number", "acceptance_test_plan_number"):
        if f in have and f in allowed:
            got = M.allowlist(out.select(key, F.coalesce(f, F.lit("")).alias("_v")), allowed[f].select("canonical", "alias"), key, "_v")
            out = out.drop(f).join(got.withColumnRenamed("canonical", f), key, "left")
        elif f in have:
            out = out.withColumn(f, F.lit("Unknown"))
    if "document_type" in allowed:
        types = allowed["document_type"].select("canonical", "alias")
        said = F.concat_ws("\n", *(F.col(c) for c in ("document_type", "document_type_acronym") if c in have), F.lit(""))
        own = M.allowlist(out.select(key, said.alias("_v")), types, key, "_v").withColumnRenamed("canonical", "_own")
        other = M.allowlist(out.select(key, F.lit(default_type_).alias("_v")), types, key, "_v").withColumnRenamed("canonical", "_default")
        out = out.join(own, key, "left").join(other, key, "left")
        kind = F.when(F.col("_own") != "Unknown", F.col("_own")).otherwise(F.col("_default"))
    else:
        kind = F.lit("Unknown")
    out = out.withColumns({"document_type": kind, "document_type_acronym": kind})
    return out.select(key, *(f for f in FIELDS if f in have or f.startswith("document_type")))


def refreshed(old: DataFrame, docs: DataFrame, allowed: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Metadata derived again from stored texts: a new value replaces the old one unless it is 'Unknown'."""
    new = text_metadata(docs, allowed, key=key)
    both = old.join(new.select(key, *(F.col(f).alias(f"_{f}") for f in FIELDS)), key, "left")
    pick = lambda f: F.when(F.coalesce(F.col(f"_{f}"), F.lit("Unknown")) != "Unknown", F.col(f"_{f}")).otherwise(F.coalesce(F.col(f) if f in old.columns else F.lit(None).cast("string"), F.lit("Unknown"))).alias(f)
    return both.select(key, *map(pick, FIELDS))


def population_rules(raw: dict, fields: dict[str, tuple[str, ...]], lower: bool = False) -> dict[str, list[str]]:
    """Configured rules under their canonical field: trimmed distinct values in order; ``lower`` for matching."""
    rules = {}
    for f, names in fields.items():
        given = [v for n in names if n in raw for v in (raw[n] if isinstance(raw[n], (list, tuple, set)) else [raw[n]] if isinstance(raw[n], str) else [])]
        values = sorted({" ".join(str(v).split()).lower() if lower else str(v).strip() for v in given} - {""})
        if values:
            rules[f] = values
    return rules


def matches_population(rules: dict[str, list[str]]) -> Column:
    """Whether a document has an allowed value in any of the rules' fields; no rules match nothing."""
    return reduce(lambda a, b: a | b, (F.coalesce(S.normalize_text(F.col(f)).isin(*(v.lower() for v in vs)), F.lit(False)) for f, vs in rules.items()), F.lit(False))


def population_description(rules: dict[str, list[str]]) -> str:
    """Rules as a sentence, fields in a fixed order and values sorted."""
    shown = {"program_title": "Program", "part_number": "Part Number", "acceptance_test_plan_number": "Acceptance Test Plan", "vendor": "Vendor", "asset_type": "Asset Type", "asset_specific_type": "Asset Specific Type"}
    parts = [f"{name}: {', '.join(values)}" for f, name in shown.items() if (values := sorted({str(v).strip() for v in rules.get(f) or []} - {""}))]
    return "Continuous plotting enabled by " + "; ".join(parts) if parts else ""
