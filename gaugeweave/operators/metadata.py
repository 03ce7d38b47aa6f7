"""Label rules and allowlist resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.functions import scalars as S


@dataclass(frozen=True)
class LabelRule:
    """A label with its phrases (matched in lower-cased text); larger priority wins, then more conditions, then the earlier rule.

    Bounds of rows and columns (0: none) and the scope (any_cell, header_row or first_col) are for tables.
    """

    label: str
    priority: int = 0
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    least_chars: int = 0
    min_rows: int = 0
    max_rows: int = 0
    min_cols: int = 0
    max_cols: int = 0
    scope: str = "any_cell"

    @property
    def for_tables(self) -> bool:
        return bool(self.min_rows or self.max_rows or self.min_cols or self.max_cols or self.scope != "any_cell")

    @property
    def specificity(self) -> int:
        return len(self.all_of) + len(self.any_of) + len(self.none_of) + (self.least_chars > 0) + sum(x > 0 for x in (self.min_rows, self.max_rows, self.min_cols, self.max_cols)) + (self.scope != "any_cell")

    def matches(self, text: Column, size: Column) -> Column:
        ok = size >= self.least_chars if self.least_chars else F.lit(True)
        for x in self.all_of:
            ok = ok & text.contains(x.lower())
        for x in self.none_of:
            ok = ok & ~text.contains(x.lower())
        if self.any_of:
            hit = F.lit(False)
            for x in self.any_of:
                hit = hit | text.contains(x.lower())
            ok = ok & hit
        return F.coalesce(ok, F.lit(False))


def rule_labels(rows: DataFrame, rules: list[LabelRule], text_col: str, size_col: str) -> DataFrame:
    """``rows`` with the label of the best rule that matches, null if none does; tables have ``table_labels``."""
    if any(r.for_tables for r in rules):
        raise ValueError("rules with bounds of rows or columns or with a scope need table_labels")
    low, size = F.lower(text_col), F.col(size_col)
    order = sorted(enumerate(rules), key=lambda x: (-x[1].priority, -x[1].specificity, x[0]))
    label = F.lit(None).cast("string")
    for _, rule in reversed(order):
        label = F.when(rule.matches(low, size), rule.label).otherwise(label)
    return rows.withColumn("label", label)


def _plain(c: Column) -> Column:
    """Lower case without quotes; what is no letter, digit or one of _./+- is a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[\"'`“”‘’]", ""), r"[^\p{L}\p{N}_./+-]+", " "), " +", " "))


def _plain_phrase(x: str) -> str:
    return " ".join(re.sub(r"[^\w./+-]+", " ", re.sub("[\"'`“”‘’]", "", x.lower())).split())


def table_labels(rows: DataFrame, rules: list[LabelRule], keys: tuple[str, ...] = ("doc_id", "table_no")) -> DataFrame:
    """(keys, label) of tables of (keys, row_no, cells): the best rule whose bounds hold and whose phrases fit the cells of its scope, null if none does.

    A table without text in a rule's scope doesn't match it.
    """
    t = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.size("cells")).alias("_cols"), F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("_rows"))
    parts = {"any_cell": F.flatten(F.transform("_rows", lambda r: r.cells)), "header_row": F.element_at("_rows", 1).cells, "first_col": F.transform("_rows", lambda r: F.try_element_at(r.cells, F.lit(1)))}
    t = t.withColumns({f"_{scope}": _plain(F.array_join(cells, " ")) for scope, cells in parts.items()})
    label = F.lit(None).cast("string")
    for _, rule in sorted(enumerate(rules), key=lambda x: (x[1].priority, x[1].specificity, -x[0])):
        hay = F.col(f"_{rule.scope}")
        phrases = LabelRule(rule.label, all_of=tuple(filter(None, map(_plain_phrase, rule.all_of))), any_of=tuple(filter(None, map(_plain_phrase, rule.any_of))), none_of=tuple(filter(None, map(_plain_phrase, rule.none_of))), least_chars=rule.least_chars)
        ok = (hay != "") & phrases.matches(hay, F.length(hay)) & (F.col("_n") >= rule.min_rows) & (F.col("_cols") >= rule.min_cols)
        if rule.max_rows:
            ok = ok & (F.col("_n") <= rule.max_rows)
        if rule.max_cols:
            ok = ok & (F.col("_cols") <= rule.max_cols)
        label = F.when(ok, rule.label).otherwise(label)
    return t.select(*keys, label.alias("label"))


def _spaced(c: Column) -> Column:
    # in lower case \W is all but a-z, 0-9 and _, and Java takes a tenth of the time that it takes for [^a-z0-9_]
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\W+", " ")), F.lit(" "))


#: A list of at most so many aliases is searched for in place; a longer one is joined. Both give the same rows.
ALIASES_IN_PLACE = 200


def _few(names: DataFrame) -> list[tuple[str, str]] | None:
    """The (alias, canonical) of a short list, longest alias first, then the smaller name; None for a long one."""
    got = names.select("alias", "canonical").limit(ALIASES_IN_PLACE + 1).collect()
    return sorted(((r.alias, r.canonical) for r in got), key=lambda x: (-len(x[0]), x[1])) if len(got) <= ALIASES_IN_PLACE else None


def _first_inside(spaced: Column, few: list[tuple[str, str]]) -> Column:
    """The name of the first alias that stands in a blob, spaced before, as whole words, else null."""
    if not few:
        return F.lit(None).cast("string")
    (alias, name), *rest = few
    out = F.when(F.contains(spaced, F.lit(f" {alias} ")), name)
    for alias, name in rest:
        out = out.when(F.contains(spaced, F.lit(f" {alias} ")), name)
    return out


def allowlist(blobs: DataFrame, allowed: DataFrame, key: str, blob: str) -> DataFrame:
    """(key, canonical): the longest alias that stands in the blob as whole words, the smaller name on ties, else 'Unknown'.

    Few aliases are searched for in place. Many are equi-joined by their number of words: the blob's runs of as many words are looked up, so no
    theta join is needed.
    """
    names = allowed.select("canonical", F.trim(_spaced(F.col("alias"))).alias("alias")).filter("alias <> ''").distinct()
    if (few := _few(names)) is not None:
        return blobs.select(key, _spaced(F.col(blob)).alias("_spaced")).select(key, F.coalesce(_first_inside(F.col("_spaced"), few), F.lit("Unknown")).alias("canonical"))
    sizes = [r[0] for r in names.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect()]
    words = F.split(F.trim(_spaced(F.col(blob))), " ")
    none = F.array().cast("array<string>")

    def runs_of(n: int) -> Column:
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(none)

    runs = [runs_of(n) for n in sizes]
    if not runs:
        return blobs.select(key, F.lit("Unknown").alias("canonical"))
    found = blobs.withColumn("_w", words).select(key, F.explode(F.array_distinct(F.concat(*runs))).alias("alias")).join(names, "alias")
    best = found.groupBy(key).agg(F.min_by("canonical", F.struct(-F.length("alias"), F.col("canonical"))).alias("canonical"))
    return blobs.select(key).join(best, key, "left").select(key, F.coalesce("canonical", F.lit("Unknown")).alias("canonical"))


def folder_names(docs: DataFrame, allowed: DataFrame, key: str, path: str, levels: int = 5) -> DataFrame:
    """(key, canonical): the longest alias that is the name of one of the ``levels`` folders above the file, the nearest folder and then the smaller name on ties; no row if none is."""
    names = allowed.select("canonical", S.alnum_spaces(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()
    folders = F.filter(F.split(F.regexp_replace(F.col(path), r"[/\\]*[^/\\]*$", ""), r"[/\\]"), lambda x: x != "")
    near = docs.select(key, F.posexplode(F.slice(F.reverse(folders), 1, levels)).alias("_at", "_name")).withColumn("alias", S.alnum_spaces(F.col("_name")))
    return near.join(names, "alias").groupBy(key).agg(F.min_by("canonical", F.struct(-F.length("alias"), F.col("_at"), F.col("canonical"))).alias("canonical"))


def _folder_in_place(path: Column, few: list[tuple[str, str]], levels: int) -> Column:
    """As :func:`folder_names`, for a short list: null if no folder has an alias as its name."""
    if not few:
        return F.lit(None).cast("string")
    folders = F.filter(F.split(F.regexp_replace(path, r"[/\\]*[^/\\]*$", ""), r"[/\\]"), lambda x: x != "")
    near = F.transform(F.slice(F.reverse(folders), 1, levels), lambda x: S.alnum_spaces(x))
    names = F.lit([c for _, c in few])
    hits = F.transform(near, lambda x, i: F.struct(-F.length(x).alias("n"), i.alias("i"), F.array_position(F.lit([a for a, _ in few]), x).alias("at")))
    best = F.array_min(F.filter(hits, lambda h: h["at"] > 0))
    return F.when(best.isNotNull(), F.get(names, (best["at"] - 1).cast("int")))


def _own_names(allowed: DataFrame) -> DataFrame:
    """(canonical, alias): a canonical name is an alias of itself; underscores part words, as they do in file names."""
    names = allowed.select("canonical", F.regexp_replace("alias", "_", " ").alias("alias"))
    return names.unionByName(allowed.select("canonical", F.regexp_replace("canonical", "_", " ").alias("alias"))).distinct()


def short_lists(allowed: DataFrame) -> tuple[list[tuple[str, str]], list[tuple[str, str]]] | None:
    """What :func:`field_in_place` looks for in texts and among folders; None if the list is long."""
    names = _own_names(allowed)
    few = _few(names.select("canonical", F.trim(_spaced(F.col("alias"))).alias("alias")).filter("alias <> ''").distinct())
    plain = _few(names.select("canonical", S.alnum_spaces(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()) if few is not None else None
    return None if plain is None else (few, plain)


def words_of(c: Column) -> Column:
    """The words of a text with single blanks between; an underscore parts words."""
    return S.alnum_spaces(c)


def spaced_words(*words: Column) -> Column:
    """The words of texts one after the other, as :func:`field_in_place` wants them, to be a column of its own: it is looked into once for each alias."""
    return F.concat(F.lit(" "), F.concat_ws(" ", *(F.when(w != "", w) for w in words)), F.lit(" "))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def field_in_place(spaced: list[Column], path: Column, lists: tuple, levels: int = 5) -> Column:
    """As :func:`strict_field`, for short lists and texts (the file name last) that are spaced: a column, so that rows stay where they are."""
    few, plain = lists
    return F.coalesce(*(_first_inside(s, few) for s in spaced), _folder_in_place(path, plain, levels), F.lit("Unknown"))


def strict_field(docs: DataFrame, allowed: DataFrame, key: str, texts: list[str], path: str, levels: int = 5) -> DataFrame:
    """(key, canonical): the allowed name in the first of ``texts`` (the label's value, the first pages) that has one, else in the file name, else that of a folder, else 'Unknown'.

    A canonical name is an alias of itself; underscores part words, as they do in file names.
    """
    blobs = [*map(F.col, texts), file_name(F.col(path))]
    if (lists := short_lists(allowed)) is not None:
        spaced = docs.select(key, F.col(path).alias("_path"), *(spaced_words(words_of(b)).alias(f"_{n}") for n, b in enumerate(blobs)))
        return spaced.select(key, field_in_place([F.col(f"_{n}") for n in range(len(blobs))], F.col("_path"), lists, levels).alias("canonical"))
    names = _own_names(allowed)
    found = folder_names(docs, names, key, path, levels).withColumn("_p", F.lit(len(blobs)))
    for n, b in enumerate(blobs):
        hits = allowlist(docs.select(key, F.regexp_replace(b, "_", " ").alias("_blob")), names, key, "_blob")
        found = found.unionByName(hits.filter("canonical <> 'Unknown'").withColumn("_p", F.lit(n)))
    best = found.groupBy(key).agg(F.min_by("canonical", "_p").alias("canonical"))
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("canonical", F.lit("Unknown")).alias("canonical"))
