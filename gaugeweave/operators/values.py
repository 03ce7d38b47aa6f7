"""Values of asked terms in documents: scores of candidates, extraction from tables and lines, resolution of keys.

A document's tables and lines are one row, since anchors and first hits depend on their order; a task looks for a document's terms
in Arrow batches. Up to ``FEW_TERMS`` terms meet every document; of more, a document meets those that an index
(:mod:`gaugeweave.operators.termindex`) finds in it, in blocks of about ``TERMS_AT_ONCE``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import scalars as S
from gaugeweave.operators import termindex
from gaugeweave.shared import durable, sized_join

FEW_TERMS = 64
TERMS_AT_ONCE = 4096
#: A number with or without thousands commas, whole: 1500 is not read as 150.
NUMBER = re.compile(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?")


@lru_cache(maxsize=1 << 16)
def words_of(text: str) -> tuple[str, ...]:
    """The distinct lower-case words of ASCII letters and digits, in order."""
    return tuple(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def key_of(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.lower())


def text_of(text: str) -> str:
    return " ".join(text.lower().split())


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """2 * matches / length; 0 if it can't reach ``least``, which upper bounds tell without matching."""
    if not a or not b:
        return 0.0
    m = SequenceMatcher(None, a, b)
    return 0.0 if m.real_quick_ratio() < least or m.quick_ratio() < least else m.ratio()


def coverage(query: str, candidate: str) -> float:
    """The share of the query's words that the candidate has; words of four letters or more also by prefix."""
    q, c = words_of(query), words_of(candidate)
    near = lambda a, b: a == b or min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a))
    return sum(any(near(a, b) for b in c) for a in q) / len(q) if q and c else 0.0


def fuzzy_score(term: str, label: str, candidate: str) -> float:
    """1 for an equal key; else the greater of coverage and the mean of coverage and ratio, of label or term."""
    key = key_of(candidate)
    keys = [(q, key_of(q)) for q in (label, term) if q]
    if any(k and k == key for _, k in keys):
        return 1.0
    return max((max(c, (ratio(k, key) + c) / 2) for q, k in keys for c in [coverage(q, candidate)]), default=0.0)


def candidate_score(term: str, label: str, candidate: str, fuzzy: bool = False, least: float = 0.78) -> float:
    """1 for an equal key only; below it coverage less a hundredth for each word too many (.12 at most), containment of the label .97 and of the term .90, and a fuzzy score that reaches ``least`` (at most .99)."""
    key, text = key_of(candidate), text_of(candidate)
    if not text:
        return 0.0
    if key and key in (key_of(label), key_of(term)):
        return 1.0

    def covered(query: str) -> float:
        c = coverage(query, candidate)
        return max(0.0, min(c, 0.99) - min(0.12, 0.01 * max(0, len(words_of(candidate)) - len(words_of(query))))) if c else 0.0

    found = [covered(label), 0.95 * covered(term)]
    found += [0.97] * bool(label.strip() and text_of(label) in text) + [0.90] * bool(term.strip() and text_of(term) in text)
    if fuzzy and (f := fuzzy_score(term, label, candidate)) >= least:
        found.append(min(0.99, f))
    return max(found)


def abbreviation(query: str, header: str) -> float:
    """The share of a header's words that stand, in order, for words of the query: one begins with the other."""
    q, at, hits = words_of(query), 0, 0
    h = re.findall("[a-z0-9]+", header.lower())
    for w in h:
        k = next((i for i in range(at, len(q)) if q[i].startswith(w) or w.startswith(q[i])), None)
        if k is not None:
            hits, at = hits + 1, k + 1
    return hits / len(h) if q and h else 0.0


def header_score(anchor: str, header: str, fuzzy: bool = True, least: float = 0.72) -> float:
    """1 if the header has all words of the anchor; else the greater of ratio and abbreviation, if it reaches ``least``."""
    if not anchor.strip() or not header.strip():
        return 0.0
    if coverage(anchor, header) >= 1:
        return 1.0
    score = max(ratio(key_of(anchor), key_of(header), least), abbreviation(anchor, header)) if fuzzy else 0.0
    return score if score >= least else 0.0


def label_fits(want: str, got: str) -> bool:
    """No label asked for, an equal one, or one with a number behind."""
    w, g = text_of(want), text_of(got)
    return not w or g == w or re.fullmatch(r" (?:\d+|\(\s*\d+\s*\))", g[len(w) :]) is not None and g.startswith(w)


@dataclass(frozen=True)
class Term:
    """What is asked for. ``after``: nothing before this anchor counts; ``heading``: only tables under it; ``kind``: number or string."""

    term: str
    label: str = ""
    heading: str = ""
    after: str = ""
    table_label: str = ""
    kind: str = "number"
    fuzzy: bool = False
    least: float = 0.78
    least_anchor: float = 0.72


def _last_text(row: list[str]) -> str:
    return next((c.strip() for c in reversed(row[1:]) if c and c.strip()), "")


def _like_anchor(anchor: str, texts: list[str], least: float) -> int | None:
    """The place of the first text that has the anchor, else of the text most like it, for anchors of six signs or more."""
    low, key = text_of(anchor), key_of(anchor)
    for i, t in enumerate(texts):
        if low and low in text_of(t):
            return i
    if len(key) < 6:
        return None
    n = len(low.split())

    def score(t: str) -> float:
        w = text_of(t).split()
        windows = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if 2 <= n < len(w) else [" ".join(w)]
        return max((1.0 if key in key_of(x) else ratio(key, key_of(x), least) for x in windows if key_of(x)), default=0.0)

    scores = [score(t) for t in texts]
    best = max(range(len(texts)), key=lambda i: (scores[i], -i), default=None)
    return best if best is not None and scores[best] >= least else None


def from_tables(blocks: list[dict], t: Term) -> tuple[str, str] | None:
    """(value, where) from blocks {heading, label, rows, kv}: key/value pairs by equal key, then by a key that holds the other; rows by their first cell; then the row most like the term."""
    key, label_key, label_text = key_of(t.term), key_of(t.label), text_of(t.label)
    if not key and not label_text:
        return None
    waiting = bool(t.after.strip())
    for b in blocks:
        if not label_fits(t.table_label, b.get("label") or ""):
            continue
        heading, rows, first = b.get("heading") or "", [[c or "" for c in r] for r in b.get("rows") or []], None
        if waiting:
            if _like_anchor(t.after, [heading], t.least_anchor) is None:
                hit = _like_anchor(t.after, [" ".join(r) for r in rows], t.least_anchor)
                if hit is None:
                    continue
                first = hit + 1
            waiting = False
        if t.heading.strip() and text_of(t.heading) not in text_of(heading):
            continue
        where = " ".join(x for x in (b.get("label") or "", heading) if x)
        kv = {} if first is not None else b.get("kv") or {}  # pairs before an anchor row must not count
        holds = lambda k, own: own and (own in k or k in own)
        value = kv.get(key) or kv.get(label_key) or next((v for k, v in kv.items() if k and len(key) >= 4 and (holds(k, key) or holds(k, label_key))), None)
        if value:
            return str(value), f"{where}: {t.term} -> {value}".strip(": ")

        def direct(cell: str) -> bool:
            k = key_of(cell)
            if label_text and (label_text in text_of(cell) or label_key and (k == label_key or len(label_key) >= 6 and k and holds(k, label_key))):
                return True
            return bool(key) and (k == key or not label_text and len(key) >= 4 and bool(k) and bool(holds(k, key)))

        body = [r for r in rows[first or 0 :] if len(r) >= 2]
        chosen = [r for r in body if direct(r[0])]
        if t.fuzzy:
            ranked = [(fuzzy_score(t.term, t.label, r[0]), -i) for i, r in enumerate(body)]
            best = max(ranked, default=(0.0, 0))
            if best[0] >= t.least:
                chosen.append(body[-best[1]])
        for r in chosen:
            if v := _last_text(r):
                return v, f"{where}: {r[0]} -> {v}".strip(": ")
    return None


def from_lines(lines: list[str], t: Term, window: int = 600) -> tuple[float | str, str] | None:
    """(value, line) of the first line that has the label or the term (or is like them): the number or text behind it, else a number on the next line, else the rest."""
    term, label = text_of(t.term), text_of(t.label)
    if not term and not label:
        return None
    start = 0
    if t.heading.strip():
        hit = next((i for i, x in enumerate(lines) if text_of(t.heading) in text_of(x)), None)
        if hit is None:
            return None
        start = hit
    end = min(len(lines), start + max(50, window))  # the window is the feature: a section's values stand near its heading
    if t.after.strip():
        hit = _like_anchor(t.after, lines[start:end], t.least_anchor)
        if hit is None:
            return None
        start += hit + 1
    number = lambda x: float(NUMBER.search(x)[0].replace(",", "")) if NUMBER.search(x) else None
    for i in range(start, end):
        line = " ".join(lines[i].split())
        low = line.lower()
        name = label if label and label in low else term if term and term in low else None
        if name is None and not (t.fuzzy and fuzzy_score(t.term, t.label, low) >= t.least):
            continue
        tail = line[low.index(name) + len(name) :] if name else line
        if t.kind == "number":
            value = number(tail)
            if value is None and i + 1 < end:
                value = number(lines[i + 1])
            if value is not None:
                return value, line
        else:
            text = re.sub("^[^:]*:", "", tail) if ":" in tail else re.sub("^[^-]*-", "", tail) if "-" in tail else tail
            if text.strip(" |"):
                return text.strip(" |"), line
        if rest := re.sub(r"^[\s:\-–—]+", "", tail).strip():
            return rest, line
    return None


def by_header(tables: list[list[list[str]]], t: Term, wanted: str, least: float = 0.72) -> tuple[str, float] | None:
    """(value, score): the cell in the column whose heading is most like ``wanted``, of the row most like the term; the best sum over all tables, the earliest on ties."""
    best: tuple[float, str] | None = None
    for rows in tables:
        heads = [(header_score(wanted, h or "", True, least), -i) for i, h in enumerate(rows[0])] if rows else []
        score, at = max(heads, default=(0.0, 0))
        if not score:
            continue
        for r in rows[1:]:
            term = candidate_score(t.term, t.label, r[0] if r else "", t.fuzzy, t.least)
            if term >= t.least and -at < len(r) and r[-at].strip() and (best is None or score + term > best[0]):
                best = score + term, r[-at].strip()
    return (best[1], best[0] / 2) if best else None


def resolved_key(keys: list[str], t: Term) -> str | None:
    """The known key of a term: an equal one (term before label), else of those that hold it or are held the best by score, length and name; in fuzzy mode the most alike, longer on ties."""
    by = {key_of(k): k for k in keys if key_of(k)}
    term, label = key_of(t.term), key_of(t.label)
    for k in (term, label):
        if k and k in by:
            return by[k]
    if not t.fuzzy:
        near = [(candidate_score(t.term, t.label, o, False, t.least), len(k), o) for k, o in by.items() if any(q and (k in q or q in k) for q in (term, label))]
        return max(near)[2] if near else None
    ranked = [(candidate_score(t.term, t.label, o, True, t.least), len(k), o) for k, o in by.items()]
    best = max(ranked, key=lambda x: x[:2], default=None)
    return best[2] if best and best[0] >= t.least else None


# many documents
FIELDS = ("term", "label", "heading", "after", "table_label", "kind", "fuzzy")


def numbered_terms(terms: DataFrame) -> DataFrame:
    """(id, term, label, by_words, t) of terms (term and any further fields of :class:`Term`), durable."""
    have = set(terms.columns)
    fields = [(F.col(c) if c in have else F.lit(None)).cast("boolean" if c == "fuzzy" else "string").alias(c) for c in FIELDS]
    t = terms.select(F.struct(*fields).alias("t")).distinct()  # asked twice is asked once
    return durable(t.select(F.monotonically_increasing_id().alias("id"), "t.term", "t.label", F.coalesce("t.fuzzy", F.lit(False)).alias("by_words"), "t"))


def asked_of(docs: DataFrame, terms: DataFrame, key: str, raw: bool) -> DataFrame:
    """(key, blocks, lines, _terms): documents with the terms that may have a value in them."""
    known = numbered_terms(terms)
    docs = docs.select(key, "blocks", "lines")
    n = known.count()
    if n <= FEW_TERMS:
        return docs.join(F.broadcast(known.agg(F.collect_list("t").alias("_terms"))))
    first = F.flatten(F.transform(F.coalesce("blocks", F.array().cast(docs.schema["blocks"].dataType)), lambda b: F.concat(F.coalesce(F.transform(b["rows"], lambda r: F.get(r, F.lit(0))), F.array().cast("array<string>")), F.coalesce(F.map_keys(b["kv"]), F.array().cast("array<string>")))))
    cells = docs.select(F.col(key).alias("doc"), F.explode(first).alias("text"))
    lines = docs.select(F.col(key).alias("doc"), F.explode("lines").alias("text"))
    by_words = F.col("by_words") | (F.lit(raw) & (F.coalesce(F.col("t.heading"), F.lit("")) != ""))
    found = termindex.candidates(cells, lines, durable(known.withColumn("by_words", by_words).drop("t")), 2 * Term.least - 1)
    of = sized_join(durable(found), known.select("id", "t"), "id").groupBy("doc", F.pmod(F.xxhash64("id"), F.lit(-(-n // TERMS_AT_ONCE))).alias("block")).agg(F.collect_list("t").alias("_terms"))
    return sized_join(docs, durable(of.select(F.col("doc").alias(key), "_terms")), key)


def packed(rows: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, blocks, lines) of table rows (key, table_no, row_no, cells, label) and text lines (key, line_no, text), for :func:`document_values`."""
    t = rows.groupBy(key, "table_no").agg(F.first("label", ignorenulls=True).alias("label"), F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    b = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("table_no", "label", F.transform("r", lambda x: x.cells).alias("rows")))).alias("b"))
    b = b.select(key, F.transform("b", lambda x: F.struct(F.lit(None).cast("string").alias("heading"), x.label.alias("label"), x.rows.alias("rows"), F.lit(None).cast("map<string,string>").alias("kv"))).alias("blocks"))
    text = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text).alias("lines"))
    return text.join(b, key, "full_outer").select(key, "blocks", "lines")


def _terms(rows: list[dict]) -> list[Term]:
    return [Term(**{k: v for k, v in r.items() if v is not None}) for r in rows]


def document_values(docs: DataFrame, terms: DataFrame, key: str = "doc_id", raw: bool = False) -> DataFrame:
    """(key, term, value, number, source, where) of documents (key, blocks, lines): from tables before lines; ``raw`` tries the header row of tables first.

    ``blocks`` is array<struct<heading, label, rows, kv>>; null blocks or lines hold nothing. With more than ``FEW_TERMS`` terms, documents
    without a key have no values.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            at = []
            for i, (tables, lines, asked) in enumerate(zip(*(b.column(n).to_pylist() for n in (1, 2, 3)), strict=True)):
                tables = [{**x, "kv": dict(x.get("kv") or [])} for x in tables or []]
                for t in _terms(asked):
                    hit, source = None, ""
                    if raw and t.heading and (h := by_header([x["rows"] for x in tables if x.get("rows")], t, t.heading)):
                        hit, source = (h[0], t.heading), "header"
                    if hit is None and (hit := from_tables(tables, t)):
                        source = "table"
                    if hit is None and lines and (hit := from_lines(lines, t)):
                        source = "line"
                    if hit:
                        m = NUMBER.search(str(hit[0]))
                        at.append(i)
                        for column, x in zip(out, (t.term, str(hit[0]), float(m[0].replace(",", "")) if m else None, source, hit[1]), strict=True):
                            column.append(x)
            columns = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.float64() if n == 2 else pa.string()) for n, c in enumerate(out))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "value", "number", "source", "where"])

    return asked_of(docs, terms, key, raw).mapInArrow(run, f"`{key}` {kind}, term string, value string, number double, source string, where string")


def cascade(found: list[DataFrame], keys: tuple[str, ...] = ("doc_id", "term")) -> DataFrame:
    """For each key the row of the first of several (keys, value, ...) that has a value, with ``source_no`` from 1."""
    both = None
    for n, f in enumerate(found, 1):
        part = f.select(*keys, "value", F.lit(n).alias("source_no")).filter("value is not null")
        both = part if both is None else both.unionByName(part)
    return both.groupBy(*keys).agg(F.min_by("value", "source_no").alias("value"), F.min("source_no").alias("source_no"))


def acceptance_keys(terms: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, resolved): each document's known key for each asked term. ``keys`` is (key, name).

    Names that may meet a term are found by the index, once for each distinct name; the choice of :func:`resolved_key` is an aggregate over their scores.
    """
    known = numbered_terms(terms)
    # of a document's names with one key the last counts
    names = durable(keys.select(F.col(key).alias("_doc"), F.col("name")).filter("name is not null").withColumn("_k", termindex.key_of(F.col("name"))).filter("_k <> ''").groupBy("_doc", "_k").agg(F.max("name").alias("name")))
    texts = durable(names.select(F.col("name").alias("doc"), F.col("name").alias("text")).distinct())
    pairs = durable(sized_join(termindex.candidates(texts, None, durable(known.drop("t")), 2 * Term.least - 1), known.select("id", "t"), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rank = [], []
            for i, (name, asked) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if r := key_rank(name, _terms([asked])[0]):
                    at.append(i)
                    rank.append(r)
            keep = pa.array(at, pa.int64())
            terms_ = b.column(1).field("term").take(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(2).take(keep), terms_, *(pa.array([r[n] for r in rank], pa.float64()) for n in range(3))], names=["name", "id", "term", "first", "score", "size"])

    scored = durable(pairs.select(F.col("doc").alias("name"), "t", "id").mapInArrow(run, "name string, id long, term string, first double, score double, size double"))
    found = sized_join(names, scored, "name") if scored.count() <= 100_000 else names.join(scored, "name")
    last = F.max_by("name", F.struct("first", "score", "size", "name"))
    return found.groupBy("_doc", "id").agg(F.first("term").alias("term"), last.alias("resolved")).select(F.col("_doc").alias(key), "term", "resolved")


def key_rank(name: str, t: Term) -> tuple[float, float, float] | None:
    """How :func:`resolved_key` ranks a known key: an equal one first (term before label), else by score and length; null if it isn't eligible."""
    k = key_of(name)
    term, label = key_of(t.term), key_of(t.label)
    if k in (term, label):
        return (2.0 if k == term else 1.0), 0.0, 0.0
    if not t.fuzzy:
        return (0.0, candidate_score(t.term, t.label, name, False, t.least), float(len(k))) if any(q and (k in q or q in k) for q in (term, label)) else None
    score = candidate_score(t.term, t.label, name, True, t.least)
    return (0.0, score, float(len(k))) if score >= t.least else None


def serial_keys(headings: DataFrame, serials: DataFrame, heading_col: str = "header", out: str = "serial") -> DataFrame:
    """``headings`` with the known serial (``serials``: serial) of each: equal, in canonical form, else the longest that is part of it; the heading itself if none is."""
    text = S.strip(F.coalesce(F.col(heading_col), F.lit("")))
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\bSN\s*0*(\d{2,})\b", 1), F.lit("")), F.when(F.contains(F.lower(text), F.lit("sn")), F.nullif(F.regexp_extract(text, r"\b(\d{3,})\b", 1), F.lit(""))))
    canonical = F.coalesce(F.concat(F.lit("SN"), F.regexp_replace(number, "^0+(?=.)", "")), text)
    known = durable(serials.select("serial").filter("serial <> ''").distinct())
    texts = durable(headings.select(text.alias("_text"), canonical.alias("_canonical")).distinct())
    equal = sized_join(texts, known.select(F.col("serial").alias("_text"), F.col("serial").alias("_equal")), "_text", "left")
    formed = durable(sized_join(equal, known.select(F.col("serial").alias("_canonical"), F.col("serial").alias("_formed")), "_canonical", "left"))
    rest = durable(formed.filter("_equal is null and _formed is null").select(F.col("_text").alias("doc"), F.col("_text").alias("text")))
    asked = durable(known.select(F.monotonically_increasing_id().alias("id"), F.col("serial").alias("term"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("by_words")))
    held = sized_join(termindex.candidates(rest, None, asked), asked.select("id", "term"), "id").filter(F.contains(F.lower("doc"), F.lower("term")))
    part = durable(held.groupBy(F.col("doc").alias("_text")).agg(F.min_by("term", F.struct(-F.char_length("term"), F.col("term"))).alias("_part")))
    found = durable(sized_join(formed, part, "_text", "left").select("_text", F.coalesce("_equal", "_formed", "_part", "_text").alias("_found")))
    return sized_join(headings.withColumn("_text", text), found, "_text", "left").withColumn(out, F.col("_found")).drop("_text", "_found")


def most_instances(tests: DataFrame) -> DataFrame:
    """(term, instance, n, term_instance): as many instances of each term as the serial with most of them has, for a workbook's rows."""
    n = tests.groupBy("term", "serial").agg(F.count("*").alias("n")).groupBy("term").agg(F.max("n").alias("n"))
    shown = F.when(F.col("n") > 1, F.concat(F.col("term"), F.lit(" ("), F.col("instance").cast("string"), F.lit(")"))).otherwise(F.col("term"))
    return n.select("term", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("instance"), "n").withColumn("term_instance", shown)


def filled_limits(rows: DataFrame, tables: DataFrame, keys: tuple[str, ...] = ("doc_id", "term")) -> DataFrame:
    """Limits and units that a row lacks, from its term's table row."""
    t = tables.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(f"_{c}") for c in ("low", "high", "units")))
    fill = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in ("low", "high")} | {"units": F.coalesce(F.nullif(F.trim("units"), F.lit("")), F.col("_units"))}
    return rows.join(t, list(keys), "left").withColumns(fill).drop("_low", "_high", "_units")


def fallback_lines(lines: DataFrame, golden: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines of documents, and the golden ones of documents that have none."""
    return lines.unionByName(golden.join(lines.select(key).distinct(), key, "left_anti"))


def instances_in_order(tests: DataFrame) -> DataFrame:
    """``tests`` with ``instance``, the number of the term's occurrence in its document."""
    return tests.withColumn("instance", F.row_number().over(Window.partitionBy("doc_id", "term").orderBy("page", "table_no", "row_no")))
