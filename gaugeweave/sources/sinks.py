"""Sinks: trending files, JSON of documents, text mirrors of tables, and facts by document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trending_csv(matrix: DataFrame, path: str) -> None:
    """Wide trending file; missing cells are blank."""
    matrix.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def summary_csv(summary: DataFrame, path: str) -> None:
    """Per-term summary with four decimals, pass rate in percent with one."""
    four = lambda c: F.format_string("%.4f", c).alias(c)
    summary.select("term", four("min_value"), four("max_value"), four("avg_value"), "total_count", "pass_count", F.format_string("%.1f%%", F.col("pass_rate") * 100).alias("pass_rate")).write.mode("overwrite").option("header", "true").csv(path)


def documents_json(rows: DataFrame, key: list[str], path: str) -> None:
    """One JSON object for each key with its rows in a list."""
    rest = [c for c in rows.columns if c not in key]
    rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)


def facts(rows: DataFrame, path: str, key: str = "document_id", buckets: int = 256) -> None:
    """Parquet in folders by a hash of the document, so their number is fixed; writing a document's rows again replaces them alone.

    The buckets that are met are written anew with their other documents' rows, each as a whole, so a write that fails leaves the old ones.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.parquet(path)
        kept = old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")
        new = new.unionByName(kept.select(*new.columns))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def text_mirror(rows: DataFrame, most_rows: int = 80, most_chars: int = 240) -> DataFrame:
    """A bounded, readable extract: the feature is the cut, as the mirror is for people."""
    cells = [F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, most_chars) for c in rows.columns]
    return rows.limit(most_rows).select(F.concat_ws(" | ", *cells).alias("line"))


# files for people and other programs
def extraction_json(documents: DataFrame, parts: dict[str, DataFrame], path: str, key: str = "document_id") -> None:
    """One JSON object for each document with the rows of each part in a list."""
    out = documents
    for name, rows in parts.items():
        packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c != key)))).alias(name))
        out = out.join(packed, key, "left")
    out.write.mode("overwrite").json(path)


def trending_json(project: DataFrame, documents: DataFrame, summary: DataFrame, path: str) -> None:
    """One object: the project, its documents and its summary. A project's documents are what one person looks at, so they stand in one row."""
    packed = [rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name)) for name, rows in (("documents", documents), ("summary", summary))]
    project.limit(1).select(F.struct(*project.columns).alias("project")).join(F.broadcast(packed[0])).join(F.broadcast(packed[1])).coalesce(1).write.mode("overwrite").json(path)


def replace_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Replaces an index's tables (truncate and insert), each written whole."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def workbook_stats(rows: DataFrame, folder: str) -> None:
    """rows.jsonl, the summary of rows and errors, and a readable text of a workbook's statistics."""
    rows.write.mode("overwrite").json(f"{folder}/rows.jsonl")
    rows.agg(F.count("*").alias("rows"), F.count("error").alias("errors"), F.count_distinct("column").alias("columns")).coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")
    text_mirror(rows).coalesce(1).write.mode("overwrite").text(f"{folder}/combined.txt")


def metadata_files(meta: DataFrame, folder: str, key: str = "doc_id") -> None:
    """A JSON object for each document's metadata, in folders by a hash of the key so that none gets too full."""
    body = F.to_json(F.struct(*(c for c in meta.columns if c != key)))
    meta.select(F.pmod(F.xxhash64(key), F.lit(1024)).alias("part"), F.to_json(F.struct(F.col(key), body.alias("metadata"))).alias("value")).write.mode("overwrite").partitionBy("part").text(folder)


def combined_text(flow: DataFrame) -> DataFrame:
    """(doc_id, text): a report's text from its flow (doc_id, page, position, kind, text): page marks, and a mark above lines, tables and titles. Lines of one document come together, as its text does."""
    mark = F.when(F.col("kind") == "title", "[Table/Chart Title]\n").when(F.col("kind") == "table", "[Table]\n\n").when(F.col("kind") == "line", "[Line]\n").otherwise("")
    items = flow.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(mark, F.col("text"), F.lit("\n")).alias("t")))).alias("items"))
    pages = items.select("doc_id", "page", F.concat(F.format_string("=== Page %d ===\n\n", F.col("page")), F.array_join(F.transform("items", lambda x: x.t), "\n")).alias("t"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x.t), "\n").alias("text"))


def page_json(tokens: DataFrame, tables: DataFrame, cells: DataFrame, path: str) -> None:
    """One JSON object for each page with its tokens, tables and cells."""
    keys = ["doc_id", "page"]
    out = None
    for name, rows in (("tokens", tokens), ("tables", tables), ("cells", cells)):
        packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys)))).alias(name))
        out = packed if out is None else out.join(packed, keys, "full_outer")
    out.write.mode("overwrite").json(path)


def report_json(parts: dict[str, DataFrame], path: str, settings: dict | None = None) -> None:
    """The report's results as one JSON object of lists: what a drawn report shows, for other programs."""
    import json

    spark = next(iter(parts.values())).sparkSession
    out = spark.createDataFrame([(json.dumps(settings or {}, sort_keys=True),)], "settings string")
    for name, rows in parts.items():
        out = out.join(F.broadcast(rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))))
    out.coalesce(1).write.mode("overwrite").json(path)


def registry_csv(rows: DataFrame, path: str, key: str = "serial") -> None:
    """A registry sorted by its key, in one file."""
    rows.coalesce(1).sortWithinPartitions(key).write.mode("overwrite").option("header", "true").csv(path)


def back_filled(config: dict, found: dict[str, dict]) -> dict:
    """A trend configuration in which columns without units or limits have those found."""
    fill = lambda c: c | {k: v for k, v in found.get(c.get("name", ""), {}).items() if c.get(k) in (None, "")}
    return config | {"columns": [fill(c) for c in config.get("columns", [])]}


def write_with_backup(spark, text: str | bytes, path: str, stamp: str) -> None:
    """Writes a small file through Hadoop's file system; what was there is kept beside it under the stamp."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(f"{path}.{stamp}.bak"))
    out = fs.create(target, True)
    try:
        out.write(bytearray(text if isinstance(text, bytes) else text.encode()))
    finally:
        out.close()


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook allows: 31 signs at most, none of []:*?/\\, numbered where they would be equal."""
    out: list[str] = []
    for n in names:
        base = "".join("_" if c in "[]:*?/\\" else c for c in n)[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            name, k = f"{base[: 31 - len(str(k)) - 1]}_{k}", k + 1
        out.append(name)
    return out


def workbook_bytes(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """An .xlsx file with a sheet for each (header, rows): numbers as numbers, lists and maps as JSON, the rest as text. Rows may be a stream; what is held is the file."""
    import io
    import json
    import zipfile
    from itertools import chain
    from xml.sax.saxutils import escape

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        text = json.dumps(v, indent=2, default=str) if isinstance(v, (dict, list)) else str(v)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("".join(ch for ch in text if ch >= " " or ch in chr(9) + chr(10)))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheet_names(list(sheets)), 1)) + "</sheets></workbook>")
        for n, (header, rows) in enumerate(sheets.values(), 1):
            def letters(k: int) -> str:
                return (letters((k - 1) // 26) if k > 26 else "") + chr(65 + (k - 1) % 26)

            with z.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate(chain([header], rows), 1):
                    f.write((f'<row r="{r}">' + "".join(cell(v).replace("<c", f'<c r="{letters(k)}{r}"', 1) for k, v in enumerate(row, 1)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbook_mirror(tables: dict[str, DataFrame], most_rows: int = 1_048_575) -> bytes:
    """A workbook with a sheet for each table. A sheet can't hold more rows than ``most_rows``, so larger tables are refused, not cut."""
    sheets = {}
    for name, rows in tables.items():
        got = rows.limit(most_rows + 1).collect()
        if len(got) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows, which no sheet holds")
        sheets[name] = (rows.columns, [tuple(v.asDict(True) if hasattr(v, "asDict") else v for v in r) for r in got])
    return workbook_bytes(sheets)
