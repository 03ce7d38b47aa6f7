"""WARC: a writer with identical-payload revisits, and a splittable reader.

Writer. Every page becomes one WARC/1.1 record in a gzip member of its own. Of records with equal payloads of at least
``min_bytes`` bytes the one with the largest page_id is the response and the others revisit it (payload dropped, the
HTTP header with the full length kept). Members reach the files through Spark's own text writer, so commits, retries and
any file system that Spark knows work as for other tables: a member's bytes stand in a string column, and the writer's
one-byte line end (NUL) supplies the member's last byte, which is 0 in every gzip member of under 16 MiB of content; a
larger one is followed by an empty member, which ends in 0 bytes too.

Reader. Spark's text source is given the three bytes of gzip magic as the line end. It splits files by byte ranges, and
each task gets the candidates that start in its range, whatever their length. A candidate counts once its gzip header and
its WARC header decode; bytes that look like magic inside a member are joined to the member again. Members that follow each other
without a gap are a chain. A range that doesn't begin a file can't tell whether its chain lies inside the payload of a
member that began before it (an archive within an archive), so its records are tentative: a second small step goes through the
undecided bytes of each file in order (a member cut by false magic beyond its range's end, and what stands before a chain) and
accepts a chain if no member is open where it starts. A file in which a chain fails this test, or breaks off, is read again in order by one
task, a member at a time. Files named .warc.gz are split too: a reader option keeps Spark from unpacking them.

Results for odd input: a null html is an empty payload; a null url has no target header; with a null page_id the
record is written and read back with a null page_id; of repeated rows of the largest page_id each is a response; an empty table
gives no records; further columns are ignored; payloads are held whole, one at a time. Bytes between members that belong to none
are passed over, as is a member that never ends; records of other kinds than response and revisit come with their kind.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import durable, new_folder, sized_join, text_batches

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + b"\x03\x00" + b"\x00" * 8
DATE = "2024-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(content: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(content) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 4) -> str:
    """Writes (page_id, url, html) as WARC files into ``folder`` and returns it. html never shuffles while the table of repeated payloads can be broadcast."""
    rows = text_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest = F.sha1("payload")
    repeated = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", digest.alias("sha")).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("first_page"))
    repeated = durable(repeated.filter("n > 1").select("sha", "first_page"))
    marked = sized_join(rows.withColumn("sha", digest), repeated, "sha", "left")
    long_enough = F.octet_length("payload") >= min_bytes
    revisit = long_enough & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, payload, sha, first, is_revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                m = _gzip(record(page_id, url, payload, digest, first, is_revisit), level)
                if m[-1]:
                    m += EMPTY_MEMBER
                out.append(m[:-1])
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    parts = marked.select("page_id", "url", "payload", "sha", "first_page", F.coalesce(revisit, F.lit(False)).alias("revisit")).mapInArrow(members, "member binary")
    parts.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").option("compression", "none").mode("overwrite").text(folder)
    return folder


def parse_record(content: bytes) -> tuple | None:
    """The fields of a decoded record; None if it isn't one."""
    if not content.startswith(b"WARC/"):
        return None
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type", "")
    page = lambda x: int(x[10:-1]) if x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
    try:
        block = rest[: int(fields.get("content-length", ""))]
    except ValueError:
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = len(payload)
    if kind == "revisit":
        for line in http.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                size = int(line[15:])
    return page(fields.get("warc-record-id", "")), size, fields.get("warc-payload-digest", "").removeprefix("sha1:"), kind, page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, fields.get("warc-target-uri"), payload if kind != "revisit" else None


class _Member:
    """A candidate being decoded; more pieces come while false magic has cut it."""

    def __init__(self) -> None:
        self.raw, self.out, self.z, self.bad = [], [], zlib.decompressobj(31), False

    def add(self, piece: bytes) -> None:
        self.raw.append(piece)
        try:
            self.out.append(self.z.decompress(piece))
        except zlib.error:
            self.bad = True
            return
        start = b"".join(self.out)[:5] if len(self.out) < 8 else b""
        self.bad = bool(start) and not b"WARC/".startswith(start)

    @property
    def done(self) -> bool:
        return self.z.eof and not self.bad


class Scanner:
    """Takes pieces (what follows each magic) in order and gives ('record', content), ('loose', bytes), ('chain', b'') where a chain begins, ('broken', b'') where one ends before the pieces do.

    ``anchored``: the pieces begin where a member begins, so chains need no proof.
    """

    def __init__(self, anchored: bool):
        self.anchored, self.chained, self.now = anchored, anchored, None

    def add(self, piece: bytes) -> Iterator[tuple[str, bytes]]:
        queue = deque([MAGIC + piece])
        while queue:
            now = self.now = self.now or _Member()
            now.add(queue.popleft())
            if now.done:
                if not self.chained:
                    self.chained = True
                    yield "chain", b""
                if content := b"".join(now.out):
                    yield "record", content
                if now.z.unused_data and not self.anchored:
                    yield "broken", b""
                self.now = None
            elif now.bad:
                if self.chained and not self.anchored:
                    yield "broken", b""
                yield "loose", now.raw[0]
                queue.extendleft(reversed(now.raw[1:]))
                self.now = None

    def end(self) -> Iterator[tuple[str, bytes]]:
        if self.now is not None:
            yield "loose", b"".join(self.now.raw)


#: Makes Hadoop take no codec for names that end in .warc.gz. Codecs are looked up by the greatest reversed suffix below
#: the reversed name; this one sorts between those of .gz and .warc.gz and fits neither, so such files are read as they are, in ranges. (Hadoop's
#: shaded client has the option under a longer name.)
AS_BYTES = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "io.compress.passthrough.extension": ".!warc.gz", "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".!warc.gz"}


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.options(**AS_BYTES).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, piece), without the first of a file, which stands before the first magic."""
    last = None
    for b in batches:
        for file, start, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if start or (file, start) == last:
                yield file, start, piece
            last = (file, start)


def _flushed(rows: Iterator[tuple], width: int) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for row in rows:
        found.append(row)
        if len(found) >= 256:
            yield _batch(found, width)
            found = []
    yield _batch(found, width)


_NO_RECORD = (None,) * 7


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, with :data:`FIELDS`; any WARC folder of gzip members."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (file, start), group in groupby(_by_range(batches), key=lambda x: x[:2]):
                scanner, nth = Scanner(start == 0), 0
                for events in chain((scanner.add(p) for *_, p in group), [scanner.end()]):
                    for kind, content in events:
                        if kind == "record":
                            if row := parse_record(content):
                                yield (*row, file, start, None, None, None)
                        else:
                            yield (*_NO_RECORD, file, start, nth, content, kind)
                            nth += 1

        yield from _flushed(rows(), 12)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            items = ((f, k, c) for b in batches for f, k, c in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True))
            for file, group in groupby(items, key=lambda x: x[0]):
                scanner, misled = Scanner(True), False
                for _, kind, content in group:
                    misled = misled or kind == "broken" or (kind == "chain" and scanner.now is not None)
                    for piece in content[len(MAGIC) :].split(MAGIC) if kind == "loose" and not misled else []:
                        for what, content_ in scanner.add(piece):
                            if what == "record" and (row := parse_record(content_)):
                                yield (*row, file, None, None, None, None)
                if misled:
                    yield (*_NO_RECORD, file, None, None, None, "misled")

        yield from _flushed(rows(), 12)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(_by_range(batches), key=lambda x: x[0]):
                scanner = Scanner(True)
                for *_, piece in group:
                    for kind, content in scanner.add(piece):
                        if kind == "record" and (row := parse_record(content)):
                            yield row

        yield from _flushed(rows(), 7)

    marked = FIELDS + ", file string, start long, nth int, loose binary, kind string"
    pieces = _pieces(spark, folder)
    both = durable(text_batches(pieces).mapInArrow(ranges, marked))
    open_ = both.filter("kind is not null").select("file", "start", "nth", "kind", "loose")
    settled = durable(open_.repartition("file").sortWithinPartitions("file", "start", "nth").mapInArrow(settle, marked))
    misled = durable(settled.filter("kind = 'misled'").select("file"))
    found = both.filter("kind is null").unionByName(settled.filter("kind is null"))
    if misled.isEmpty():
        return found.select(*names)
    # numbers grow within a range where it is read; a join that shuffles would lose that order
    numbered = sized_join(pieces.withColumn("nth", F.monotonically_increasing_id()), misled, "file", "left_semi")
    again = numbered.repartition("file").sortWithinPartitions("file", "start", "nth").select("file", "start", "piece").mapInArrow(in_order, FIELDS)
    return sized_join(found, misled, "file", "left_anti").select(*names).unionByName(again)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "file", "start", "nth", "loose", "kind"]


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:width], _TYPES, strict=False)], names=_NAMES[:width])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = write_archives(pages, new_folder(spark, "warc"), min_bytes)
    read = read_archives(spark, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
