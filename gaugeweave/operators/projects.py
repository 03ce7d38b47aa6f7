"""Projects, their documents and terms, run labels and workbook forms of the trending family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import scalars as S


def project_documents(documents: DataFrame, bridge: DataFrame, project_id: int) -> DataFrame:
    """A project's documents by date and serial."""
    return documents.join(bridge.filter(F.col("project_id") == project_id).select(F.col("document_id").alias("id")), "id").orderBy("test_date", "serial")


def project_terms(registry: DataFrame, settings: DataFrame, project_id: int) -> DataFrame:
    """All registered terms with a project's settings, which are filtered before the join so that terms without any stay."""
    own = settings.filter(F.col("project_id") == project_id).select("term_id", "enabled", "display_order")
    out = registry.join(own, registry["id"] == own["term_id"], "left").drop("term_id")
    return out.withColumn("display_order", F.coalesce("display_order", F.lit(999))).orderBy("display_order", "category", "term")


def auto_assign(documents: DataFrame, kind: str, value: str) -> DataFrame:
    """Documents that a project takes by its grouping: equal program or model, or a serial prefix whatever the case."""
    rule = {"program": F.col("program") == value, "valve_model": F.col("valve_model") == value, "serial_prefix": S.like_prefix(F.col("serial"), value)}[kind]
    return documents.filter(rule)


def register_terms(registry: DataFrame, tests: DataFrame) -> DataFrame:
    """The registry with the terms of tests that it lacks: of each the first seen, with ids that go on."""
    w = Window.partitionBy("term").orderBy("id")
    new = tests.join(registry.select("term"), "term", "left_anti").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # distinct terms are a vocabulary, and numbering them is one small sorted window
    numbered = new.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("term"))).join(F.broadcast(top))
    return registry.unionByName(numbered.select((F.col("top") + F.col("_k")).alias("id"), "term", F.lit("auto").alias("category")).select(*registry.columns))


def link(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs added once."""
    return bridge.unionByName(new).dropDuplicates()


def unlink(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    return bridge.join(gone, bridge.columns, "left_anti")


def trending_long(wide: DataFrame, fixed: list[str], serials: list[str]) -> DataFrame:
    """A workbook's serial columns as rows: fixed columns, serial, position, text and number."""
    rows = wide.unpivot(fixed, serials, "serial", "value_text")
    position = F.array_position(F.array(*map(F.lit, serials)), F.col("serial"))
    return rows.withColumns({"position": position.cast("int"), "value_num": S.first_number(F.col("value_text"))})


def label_value(c: Column) -> Column:
    """Numbers that are whole to within 1e-9 show as integers."""
    n = S.finite_number(c)
    return F.when(n.isNotNull() & (F.abs(n - F.round(n)) < 1e-9), F.round(n).cast("long").cast("string")).otherwise(c.cast("string"))


def run_labels(values: DataFrame, template: str, missing: str = "?") -> DataFrame:
    """(run, label): the template with each {variable} replaced by the run's value; equal labels get their run behind."""
    label = F.lit(template)
    per_run = values.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("variable", label_value(F.col("value"))))).alias("_v"))
    parts = template.split("{")
    for name in (p.split("}")[0] for p in parts[1:]):
        label = F.replace(label, F.lit("{" + name + "}"), F.coalesce(F.element_at("_v", F.lit(name)), F.lit(missing)))
    out = per_run.select("run", label.alias("label"))
    n = F.count("*").over(Window.partitionBy("label"))
    return out.select("run", F.when(n > 1, F.concat(F.col("label"), F.lit(" — "), F.col("run"))).otherwise(F.col("label")).alias("label"))


def default_axis(columns: DataFrame, preferred: list[str]) -> DataFrame:
    """(run, default_x): of each run the column that comes first in the preferred list, by normalised name."""
    rank = F.array_position(F.array(*[F.lit("".join(ch for ch in p.lower() if ch.isalnum())) for p in preferred]), S.normalize_key(F.col("name")))
    return columns.withColumn("_r", rank).filter("_r > 0").groupBy("run").agg(F.min_by("name", F.struct("_r", "name")).alias("default_x"))


def resolve_columns(targets: DataFrame, columns: DataFrame) -> DataFrame:
    """(run, target, name): the column whose normalised name is the target's, else the target."""
    have = columns.groupBy("run", S.normalize_key(F.col("name")).alias("_k")).agg(F.min("name").alias("name"))
    return targets.withColumn("_k", S.normalize_key(F.col("target"))).join(have, ["run", "_k"], "left").select("run", "target", F.coalesce("name", "target").alias("name"))


def stale(cached: DataFrame, sources: DataFrame) -> DataFrame:
    """Serials whose cached fingerprint differs from the source's, or that only one side has."""
    s = sources.select("serial", F.col("fingerprint").alias("_now"))
    return cached.join(s, "serial", "full_outer").filter(~F.col("fingerprint").eqNullSafe(F.col("_now"))).select("serial")


def append_sources(project: DataFrame, documents: DataFrame, rules: Column) -> DataFrame:
    """Serials of documents that match the project's rules and that it lacks."""
    return documents.filter(rules).select("serial").distinct().join(project.select("serial"), "serial", "left_anti")


def acceptance_candidates(tests: DataFrame, wanted: DataFrame) -> DataFrame:
    """The k-th occurrence of a term in a document for the k-th row that asks for it; an explicit (n) overrides the count."""
    n = F.row_number().over(Window.partitionBy("doc_id", "term_key").orderBy("page", "table_no", "row_no"))
    have = tests.withColumn("term_key", S.normalize_key(F.col("term"))).withColumn("n", n)
    ask = wanted.withColumn("_i", S.split_instance(F.col("term"))).withColumn("term_key", S.normalize_key(F.col("_i.term")))
    k = F.row_number().over(Window.partitionBy("term_key").orderBy("row_order"))
    ask = ask.withColumn("n", F.coalesce("_i.n", k)).select(F.col("term").alias("wanted"), "term_key", "n")
    return ask.join(have, ["term_key", "n"]).select("wanted", "doc_id", "measured_value", "computed_pass")
