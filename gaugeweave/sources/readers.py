"""Sources: file listings, OCR tables, report text with line numbers, workbooks, SQLite files, metadata JSON, registries.

Files are listed and read by Spark's own readers, so any file system that Spark knows works. Formats that Spark has no reader
for (workbooks, SQLite) are parsed from their bytes by Arrow-batched functions; a file that can't be read becomes a row with an error.
"""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATA_SUFFIXES = ("pdf", "xlsx", "xls", "xlsm")


def split_dirs(option: str | None) -> set[str]:
    """Directory names of an option list, parted by ; or , whatever their case."""
    return {x.strip().casefold() for x in re.split("[;,]", option or "") if x.strip()}


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = DATA_SUFFIXES, ignore: str | None = None) -> DataFrame:
    """(path, size_bytes, modified, name) under root, without temporary files and ignored directories; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    parts = F.split(F.lower("path"), "/")
    out = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes) & ~F.col("name").startswith("~$"))
    for d in sorted(split_dirs(ignore)):
        out = out.filter(~F.array_contains(parts, d))
    return out


def fingerprint(files: DataFrame) -> DataFrame:
    return files.withColumn("fingerprint", F.concat_ws(":", "size_bytes", F.unix_micros(F.col("modified").cast("timestamp"))))


def tesseract_tsv(spark: SparkSession, path: str, least_conf: float = 30.0) -> DataFrame:
    """Word tokens of OCR tables: level 5, enough confidence, text; confidence as a share, box and centre."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="")
    rows = rows.filter((F.col("level") == 5) & (F.col("conf") >= least_conf) & (F.trim("text") != ""))
    x1, y1 = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return rows.select(F.col("page_num").alias("page"), "block_num", "par_num", "line_num", "word_num", F.trim("text").alias("text"), (F.col("conf") / 100).alias("conf"), F.col("left").alias("x0"), F.col("top").alias("y0"), x1.alias("x1"), y1.alias("y1"), ((F.col("left") + x1) / 2).alias("cx"), ((F.col("top") + y1) / 2).alias("cy"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text) of report files: line numbers count within a file."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))


def metadata_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Metadata files (*_metadata.json, *.metadata.json) under root, one row each; broken ones are null rows."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{_,.}metadata.json").json(root).withColumn("path", F.col("_metadata.file_path"))


def registry_csv(spark: SparkSession, path: str, key: str = "serial") -> DataFrame:
    """The last row of each serial, by file name, then by place in the file; literal N/A stays text."""
    rows = spark.read.option("header", "true").option("nullValue", "\u0000").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))  # ids grow within a range of a file
    w = Window.partitionBy(key).orderBy(F.desc("_n"))
    return rows.withColumn("_n", place).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_n", "_r")


def env_file(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and blank lines are skipped."""
    pairs = (x.split("=", 1) for x in map(str.strip, text.splitlines()) if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def merged(*layers: dict) -> dict:
    """Nested settings, later layers over earlier ones."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


_TAG = {name: f"{{{_NS['m']}}}{name}" for name in ("c", "v", "is", "t", "si", "row", "sst", "sheetData")}


def _shared_texts(z: zipfile.ZipFile) -> list[str]:
    """The workbook's table of texts, read as a stream."""
    texts = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            table = None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    table = e if e.tag == _TAG["sst"] else table
                elif e.tag == _TAG["si"]:
                    texts.append("".join(t.text or "" for t in e.iter(_TAG["t"])))
                    table.clear()  # the element, and that it was there
    return texts


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the filled cells of an .xlsx or .xlsm file; sheets are read as streams, a row at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _shared_texts(z)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                data = None
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    if event == "start":
                        data = e if e.tag == _TAG["sheetData"] else data
                    elif e.tag == _TAG["c"]:
                        letters, digits = re.match("([A-Z]+)([0-9]+)", e.get("r")).groups()
                        col = 0
                        for x in letters:
                            col = col * 26 + ord(x) - 64
                        v, inline = e.find("m:v", _NS), e.find("m:is", _NS)
                        text = "".join(t.text or "" for t in inline.iter(_TAG["t"])) if inline is not None else v.text if v is not None else None
                        if text is not None:
                            yield sheet.get("name"), int(digits), col, shared[int(text)] if e.get("t") == "s" else text
                    elif e.tag == _TAG["row"]:
                        data.clear()  # a row that stays, even empty, would make memory grow with the sheet


#: Cells that go out of a task at once.
CELLS_AT_ONCE = 50_000


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, excel_row, excel_col, value, error) of files (path, content): all filled cells in long form; what can't be read (on) is one row with its error.

    Spark bounds the batches of files by bytes, a file's sheets are read as streams, and its cells go out in parts, so memory depends on the largest file alone.
    """
    names = ["path", "sheet", "excel_row", "excel_col", "value", "error"]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"excel_row": "Int64", "excel_col": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for c in workbook_cells(bytes(content)):
                        rows.append((p, *c, None))
                        if len(rows) == CELLS_AT_ONCE:
                            yield frame(rows)
                            rows = []
                except Exception as e:  # noqa: BLE001  one bad file must not end the import
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"))
                yield frame(rows)

    kind = dict(files.dtypes)["path"]
    return files.select("path", "content").mapInPandas(run, f"path {kind}, sheet string, excel_row int, excel_col int, value string, error string")


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """:func:`workbook_rows` of all workbooks under a path."""
    return workbook_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xls[xm]").load(path))


def sqlite_rows(files: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of a query over every SQLite file of files (path, content), with the file's path in front; rows are fetched and go out in parts."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with closing(sqlite3.connect(":memory:")) as c:
                    c.deserialize(bytes(content))
                    found = c.execute(sql)
                    while rows := found.fetchmany(CELLS_AT_ONCE):
                        yield pd.DataFrame([(p, *r) for r in rows], columns=["path", *names])

    kind = dict(files.dtypes)["path"]
    return files.select("path", "content").mapInPandas(run, f"path {kind}, " + schema)


def sqlite_table(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """:func:`sqlite_rows` of all SQLite files under a path."""
    return sqlite_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{db,sqlite,sqlite3}").load(path), sql, schema)


def is_header_cell(value: Column, longest: int = 120) -> Column:
    """Whether a cell may be a heading: a text with a letter, not a number, not too long."""
    number = value.rlike(r"^\s*[+-]?[0-9][0-9,]*(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$")
    return F.coalesce(~number & value.rlike(r"\p{L}") & (F.length(value) <= longest), F.lit(False))


def header_rows(cells: DataFrame, key: list[str], lookahead: int = 60, least_numbers: int = 8, least_share: float = 0.6, scan_rows: int = 200, share_weight: float = 3.0, least_columns: int = 1) -> DataFrame:
    """(key, header_row, score) of each sheet: the early row whose text cells stand over the most numbers in the rows below.

    Each cell looks ahead by a running window over its column, not a range join. Score: sum over header-like columns of the count of
    numbers plus ``share_weight`` times their share (0 for the statistics of a sheet), plus a little for earlier rows; the first of the best wins.
    """
    number = F.col("value").rlike(r"^\s*[+-]?[0-9][0-9,]*(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$")
    ahead = Window.partitionBy(*key, "excel_col").orderBy("excel_row").rangeBetween(1, lookahead)
    looked = cells.withColumns({"_n": F.coalesce(F.sum(F.when(number, 1).otherwise(0)).over(ahead), F.lit(0)), "_all": F.count("*").over(ahead)})
    share = F.col("_n") / F.greatest("_all", F.lit(1))
    header = is_header_cell(F.col("value")) & (F.col("excel_row") <= scan_rows) & (F.col("_n") >= least_numbers) & (share >= least_share)
    rows = looked.filter(header).groupBy(*key, "excel_row").agg((F.sum(F.col("_n") + share_weight * share) + 0.001 * (scan_rows - F.col("excel_row"))).alias("score"), F.count("*").alias("_columns")).filter(F.col("_columns") >= least_columns)
    return rows.groupBy(*key).agg(F.max_by("excel_row", F.struct("score", -F.col("excel_row"))).alias("header_row"), F.max("score").alias("score"))


def best_sheet(headers: DataFrame, workbook: list[str]) -> DataFrame:
    """The sheet and header row of the best score in each workbook, the smaller name on ties."""
    w = Window.partitionBy(*workbook).orderBy(F.desc("score"), "sheet")
    return headers.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def sheet_values(cells: DataFrame, headers: DataFrame, key: list[str]) -> DataFrame:
    """(key, excel_row, column, value): numbers below the header row by the header's safe name, repeated names numbered."""
    from gaugeweave.functions.scalars import safe_identifier, strict_number

    joined = cells.join(headers.select(*key, "header_row"), key)
    names = joined.filter(F.col("excel_row") == F.col("header_row")).select(*key, "excel_col", safe_identifier(F.col("value")).alias("base"))
    n = F.row_number().over(Window.partitionBy(*key, "base").orderBy("excel_col"))
    names = names.select(*key, "excel_col", F.when(n > 1, F.concat("base", F.lit("_"), n.cast("string"))).otherwise(F.col("base")).alias("column"))
    return joined.filter(F.col("excel_row") > F.col("header_row")).join(names, [*key, "excel_col"]).select(*key, "excel_row", "column", strict_number(F.col("value")).alias("value"))
