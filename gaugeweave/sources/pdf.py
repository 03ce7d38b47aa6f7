"""Tokens that a processing run leaves inside PDF files: entries of the information dictionary and of the XMP packet.

A file is read as Spark's binary rows, in batches bounded by bytes; the trailer is looked for from its end: ``startxref``, the cross-reference tables and streams
before it, then the objects of /Info and of the catalogue's /Metadata alone. Where the tables are broken, objects are looked for by their headings, the last one of a number first.

Every file is a row: what isn't a PDF, is encrypted or has no readable trailer says so in ``reason`` and has no token.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TAIL = 1 << 16
#: More bytes than this are not unpacked from one stream: packets and tables are far smaller.
UNPACKED = 16 << 20


class Damaged(Exception):
    pass


_SPACE = rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*"
_TOKEN = re.compile(_SPACE + rb"(?:(<<)|(>>)|(\[)|(\])|(\()|<([0-9A-Fa-f\s]*)>|/([^\0\t\n\f\r ()<>\[\]{}/%]*)|(\d+)\s+(\d+)\s+R(?![A-Za-z])|([-+.\dA-Za-z]+))")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Name:
    text: str


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string in parentheses that begins before ``at``, and where it ends."""
    depth, out = 1, bytearray()
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif m := re.compile(rb"\r\n?|\n").match(data, at):
                at = m.end()
            else:
                out += _ESCAPES.get(data[at : at + 1], data[at : at + 1])
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Damaged("string without an end")


def parsed(data: bytes, at: int, depth: int = 0):
    """(value, where it ends) of the object at ``at``: dict, list, bytes, Name, Ref, number or word."""
    m = _TOKEN.match(data, at)
    if not m or depth > 50:
        raise Damaged(f"no object at {at}")
    at = m.end()
    if m[1]:
        out: dict = {}
        while not (end := re.compile(_SPACE + rb">>").match(data, at)):
            key, at = parsed(data, at, depth + 1)
            if not isinstance(key, Name):
                raise Damaged("dictionary without a name")
            out[key.text], at = parsed(data, at, depth + 1)
        return out, end.end()
    if m[3]:
        items = []
        while not (end := re.compile(_SPACE + rb"\]").match(data, at)):
            item, at = parsed(data, at, depth + 1)
            items.append(item)
        return items, end.end()
    if m[5]:
        return _literal(data, at)
    if m[6] is not None:
        digits = re.sub(rb"\s", b"", m[6])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if m[7] is not None:
        return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[7].decode("latin-1"))), at
    if m[8]:
        return Ref(int(m[8])), at
    if m[10]:
        word = m[10].decode()
        return (float(word) if "." in word else int(word)) if re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)", word) else word, at
    raise Damaged(f"no object at {at}")


def text_of(value) -> str:
    """A string of the information dictionary as text."""
    if isinstance(value, Name):
        return value.text
    if not isinstance(value, bytes):
        return "" if value is None else str(value)
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value.decode("utf-16", "replace")
    return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")


@dataclass
class Pdf:
    data: bytes
    places: dict[int, tuple[int, int]] = field(default_factory=dict)  # number: (offset, -1) or (number of an object stream, index)
    trailer: dict = field(default_factory=dict)

    @staticmethod
    def opened(data: bytes) -> Pdf:
        if b"%PDF-" not in data[:1024]:
            raise Damaged("not a PDF")
        p = Pdf(data)
        try:
            found = list(re.finditer(rb"startxref\s+(\d+)", data[-TAIL:]))
            p._tables(int(found[-1][1])) if found else None
            if not isinstance(p.object(p.trailer.get("Root")), dict):
                raise Damaged("no catalogue")
        except (Damaged, ValueError, IndexError, KeyError, zlib.error):
            p._search()
        if not p.trailer:
            raise Damaged("no trailer")
        return p

    def _tables(self, at: int) -> None:
        """Cross-reference tables and streams from the newest to the oldest; newer entries hold."""
        seen = set()
        while at not in seen and 0 <= at < len(self.data):
            seen.add(at)
            m = re.compile(_SPACE + rb"xref\s").match(self.data, at)
            if m:
                at = m.end()
                while s := re.compile(_SPACE + rb"(\d+)\s+(\d+)\s+").match(self.data, at):
                    at = s.end()
                    for n in range(int(s[2])):
                        e = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])").match(self.data, at)
                        if not e:
                            raise Damaged("cross-reference entry")
                        at = e.end()
                        if e[3] == b"n":
                            self.places.setdefault(int(s[1]) + n, (int(e[1]), -1))
                t = re.compile(_SPACE + rb"trailer").match(self.data, at)
                if not t:
                    raise Damaged("no trailer")
                entries, _ = parsed(self.data, t.end())
                if isinstance(entries.get("XRefStm"), int):
                    self._stream_table(entries["XRefStm"])
            else:
                entries = self._stream_table(at)
            self.trailer = entries | self.trailer
            at = entries.get("Prev", -1)

    def _stream_table(self, at: int) -> dict:
        entries, body = self._at(at)
        if body is None or not isinstance(entries.get("W"), list):
            raise Damaged("cross-reference stream")
        a, b, c = entries["W"]
        size, index = a + b + c, entries.get("Index") or [0, entries["Size"]]
        k = 0
        for first, many in zip(index[::2], index[1::2], strict=True):
            for n in range(first, first + many):
                row = body[k : k + size]
                k += size
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
                if kind in (1, 2) and len(row) == size:
                    self.places.setdefault(n, (x, -1 if kind == 1 else y))
        return entries

    def _search(self) -> None:
        """Objects by their headings, trailers by their word; later ones hold."""
        self.places = {int(m[1]): (m.start(), -1) for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", self.data)}
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                entries, _ = parsed(self.data, m.end())
                self.trailer |= entries
            except (Damaged, ValueError, AttributeError):
                continue
        for place, _ in list(self.places.values()):
            if b"/XRef" in self.data[place : place + 512] or not self.trailer and b"/Catalog" in self.data[place : place + 512]:
                try:
                    entries, _ = self._at(place)
                    kind = entries.get("Type")
                    if isinstance(kind, Name):
                        self.trailer |= {k: entries[k] for k in ("Root", "Info", "Encrypt") if k in entries} if kind.text == "XRef" else {"Root": entries}
                except (Damaged, ValueError, AttributeError, zlib.error):
                    continue

    def _at(self, at: int) -> tuple:
        """(object, stream or None) of the object that begins at ``at``."""
        m = re.compile(_SPACE + rb"(\d+)\s+\d+\s+obj\b").match(self.data, at)
        if not m:
            raise Damaged(f"no object at {at}")
        value, end = parsed(self.data, m.end())
        s = re.compile(_SPACE + rb"stream\r?\n").match(self.data, end)
        if not s or not isinstance(value, dict):
            return value, None
        size = self.object(value.get("Length"))
        stop = s.end() + size if isinstance(size, int) and re.compile(rb"\s*endstream").match(self.data, s.end() + size) else self.data.find(b"endstream", s.end())
        body = self.data[s.end() : stop if stop >= 0 else len(self.data)]
        filters = self.object(value.get("Filter"))
        for f in [filters] if isinstance(filters, Name) else filters or []:
            if not isinstance(f, Name) or f.text not in ("FlateDecode", "Fl"):
                raise Damaged("filter")
            d = zlib.decompressobj()
            body = d.decompress(body, UNPACKED)
        return value, _unpredicted(body, self.object(value.get("DecodeParms")))

    def object(self, value, depth: int = 0):
        """A value, looked up if it is a reference."""
        if not isinstance(value, Ref):
            return value
        if value.number not in self.places or depth > 20:
            return None
        place, index = self.places[value.number]
        if index < 0:
            found, _ = self._at(place)
            return self.object(found, depth + 1)
        entries, body = self._at(self.places[place][0])
        heads = [int(x) for x in body[: entries["First"]].split()]
        return self.object(parsed(body, entries["First"] + heads[2 * index + 1])[0], depth + 1)

    def stream(self, value) -> bytes | None:
        if not isinstance(value, Ref) or self.places.get(value.number, (0, 0))[1] >= 0:
            return None
        return self._at(self.places[value.number][0])[1]


def _unpredicted(body: bytes, parms) -> bytes:
    if isinstance(parms, list):
        parms = parms[0] if parms else None
    if not isinstance(parms, dict) or parms.get("Predictor", 1) < 10:
        return body
    width = (parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) + 7) // 8
    out, above = bytearray(), bytes(width)
    for at in range(0, len(body), width + 1):
        kind, row = body[at], bytearray(body[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up = (row[i - 1] if i else 0), above[i]
            row[i] = (row[i] + (left if kind == 1 else up if kind == 2 else (left + up) // 2 if kind == 3 else 0)) & 255
        above = bytes(row).ljust(width, b"\0")
        out += row
    return bytes(out)


def token_in(data: bytes | None, marker: str) -> tuple[str | None, str | None]:
    """(where the marker stands: 'info', 'xmp' or None; why the file couldn't be read, or None)."""
    if not data:
        return None, "empty"
    low = marker.lower()
    try:
        p = Pdf.opened(data)
        if p.object(p.trailer.get("Encrypt")) is not None:
            return None, "encrypted"
        info = p.object(p.trailer.get("Info"))
        if isinstance(info, dict) and any(low in k.lower() or low in text_of(p.object(v)).lower() for k, v in info.items()):
            return "info", None
        root = p.object(p.trailer.get("Root"))
        packet = p.stream(root.get("Metadata")) if isinstance(root, dict) else None
        encoding = "utf-16" if packet and packet[:2] in (b"\xfe\xff", b"\xff\xfe") else "utf-8"
        return ("xmp" if packet and low in packet.decode(encoding, "replace").lower() else None), None
    except Damaged as e:
        return None, str(e) if str(e) == "not a PDF" else "damaged"
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError, zlib.error):
        return None, "damaged"


def tokens(files: DataFrame, marker: str, key: str = "path") -> DataFrame:
    """(key, has_token, found_in, reason) of files (key, content)."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [token_in(None if c is None else bytes(c), marker) for c in pdf["content"]]
            yield pd.DataFrame({key: pdf[key], "has_token": [x[0] is not None for x in found], "found_in": [x[0] for x in found], "reason": [x[1] for x in found]}, columns=[key, "has_token", "found_in", "reason"])

    return files.select(key, "content").mapInPandas(run, f"`{key}` {kind}, has_token boolean, found_in string, reason string")


def read_tokens(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """:func:`tokens` of every PDF file under a path; Spark's reader leaves files without a byte out."""
    return tokens(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path), marker)
