"""Similarity of short texts by matching blocks: Arrow-batched functions, for parity with the standard library's ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def ratio(a: Column, b: Column) -> Column:
    """2 * matches / total length; null if either is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def assign_headers(headers: DataFrame, wanted: list[str], key: list[str], least: float = 0.72) -> DataFrame:
    """(key, position, header, name): each sheet's headers matched one to one with wanted names, best scores first.

    Equal normalised texts score 1, containment 0.92, others their ratio. Ties go to the earlier header, then the smaller name. The
    choice is sequential, so a sheet's headers, which are few, are one group.
    """
    norm = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())

    def score(a: str, b: str) -> float:
        x, y = norm(a), norm(b)
        if not x or not y:
            return 0.0
        return 1.0 if x == y else 0.92 if x in y or y in x else _ratio(x, y)

    names = [*key, "position", "header", "name"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = sorted((-score(h, w), p, w, h) for p, h in zip(pdf["position"], pdf["header"], strict=True) for w in wanted)
        used_p, used_w, out = set(), set(), []
        for s, p, w, h in ranked:
            if -s >= least and p not in used_p and w not in used_w:
                used_p.add(p)
                used_w.add(w)
                out.append((*pdf.iloc[0][key], p, h, w))
        return pd.DataFrame(out, columns=names)

    types = dict(headers.dtypes)
    return headers.groupBy(*key).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in [*key, "position", "header"]) + ", name string")
