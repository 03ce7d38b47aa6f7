"""Names, codes, times and tokens: scalar column functions, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeweave.functions import scalars as S

#: Forms of a run's date and time.
TIME_FORMS = (r"yyyy-M-d H:m:s", r"yyyy/M/d H:m:s", r"M/d/yyyy H:m", r"yyyy-M-d")
#: Forms of an acceptance test plan's number in free text; the first that occurs is taken.
PLAN_FORMS = (
    r"(?i)\b(?:ACCEPTANCE\s+TEST\s+PLAN|TEST\s+PLAN|ACCEPTANCE\s+PLAN)\s*(?:NO\.|NUMBER|#|:)?\s*([A-Z]{1,6}[-_\s]?\d{1,8}[A-Z0-9\-_/]{0,16})\b",
    r"(?i)\b(?:ATP|TP)\s*[-_#:]?\s*(\d{1,8}[A-Z0-9\-_/]{0,16})\b",
    r"(?i)\b(ATP[-_ ]?\d{1,8}[A-Z0-9\-_/]{0,16})\b",
    r"(?i)\b(TP[-_ ]?\d{1,8}[A-Z0-9\-_/]{0,16})\b",
)


def title_key(c: Column) -> Column:
    """A title's lower-case letters and digits; '' for null."""
    return F.coalesce(S.normalize_key(c), F.lit(""))


def phrase_text(c: Column) -> Column:
    """For phrases: lower case without quotes, words and the signs . / + - kept, single blanks."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\"'`“”‘’]", "")
    return S.strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s./+-]+", " "), r"(?U)\s+", " "))


def fact_text(c: Column) -> Column:
    """For facts: lower-case words of ASCII letters and digits, single blanks."""
    return S.alnum_spaces(F.coalesce(c, F.lit("")))


def sheet_table(c: Column) -> Column:
    """The table that holds a sheet."""
    return F.concat(F.lit("sheet__"), S.safe_identifier(c, "sheet"))


def program_code(c: Column) -> Column:
    """A code as it stands in the text (AB_12), else the text's words in upper case with underscores."""
    up = F.upper(F.coalesce(c, F.lit("")))
    code = F.regexp_extract(up, r"\b[A-Z0-9]+(?:_[A-Z0-9]+)+\b", 0)
    return F.when(code != "", code).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(up, r"(?U)[^\w]+", "_"), "_+", "_"), "^_|_$", ""))


def stem(path: Column) -> Column:
    """A path's file name without its last suffix."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _parts(name: Column) -> Column:
    return F.filter(F.transform(F.split(name, "_"), lambda p: F.trim(p)), lambda p: p != "")


def workbook_identity(path: Column) -> Column:
    """struct(program, vehicle, serial) of names like Program_Vehicle_SN1001.xlsx; the serial is the last part that begins with SN."""
    parts = _parts(stem(path))
    serial = F.try_element_at(F.filter(F.reverse(parts), lambda p: F.lower(p).startswith("sn") & (F.length(p) > 2)), F.lit(1))
    digits = F.regexp_extract(serial, r"(?i)^SN[-_ ]?(\d+)$", 1)
    shown = F.when(digits != "", F.concat(F.lit("SN"), digits)).otherwise(F.upper(serial))
    at = lambda n: F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(""))
    return F.struct(at(1).alias("program"), at(2).alias("vehicle"), F.coalesce(shown, F.lit("")).alias("serial"))


def package_identity(path: Column) -> Column:
    """struct(program, vehicle, serial) of a package's name: three parts or more are all, two are program and serial, one is the serial."""
    parts, n = _parts(stem(path)), F.size(_parts(stem(path)))
    at = lambda k: F.try_element_at(parts, F.lit(k))
    serial = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(3), F.greatest(n, F.lit(1))), "_")).when(n == 2, at(2)).when(n == 1, at(1)).otherwise(stem(path))
    return F.struct(F.when(n >= 2, at(1)).otherwise("").alias("program"), F.when(n >= 3, at(2)).otherwise("").alias("vehicle"), serial.alias("serial"))


def run_time(c: Column) -> Column:
    """A timestamp in the first of four forms that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIME_FORMS))


def plan_number(text: Column) -> Column:
    """The number of an acceptance test plan in a text, upper case without blanks; null if there is none."""
    found = [F.nullif(F.regexp_replace(F.upper(F.regexp_extract(text, p, 1)), r"\s+", ""), F.lit("")) for p in PLAN_FORMS]
    return F.coalesce(*found)


def return_type(smart: Column, existing: Column, hint: Column) -> Column:
    """'number' or 'string': by the kind of snap, else as it was, else as hinted, else a number."""
    s, e = F.lower(F.trim(F.coalesce(smart, F.lit("")))), F.lower(F.trim(F.coalesce(F.nullif(existing, F.lit("")), hint, F.lit(""))))
    return F.when(s.isin("number", "num", "value"), "number").when(s.isin("date", "time", "title"), "string").when(e.isin("number", "string"), e).otherwise("number")


def pointer_token(payload: Column, prefix: str = "PTR:") -> Column:
    """A payload struct as base64url JSON behind a prefix, which names the system that made it."""
    plain = F.base64(F.encode(F.to_json(payload), "UTF-8"))
    return F.concat(F.lit(prefix), F.translate(F.regexp_replace(plain, r"\s", ""), "+/", "-_"))


def pointer_payload(token: Column, prefix: str = "PTR:") -> Column:
    """The JSON of a token; null if it isn't one."""
    body = F.translate(F.substring(token, len(prefix) + 1, 1 << 30), "-_", "+/")
    return F.when(F.startswith(token, F.lit(prefix)), F.decode(F.unbase64(body), "UTF-8"))


def file_sha1(content: Column) -> Column:
    return F.sha1(content)


def shown_time(epoch_ns: Column) -> Column:
    """Nanoseconds of the epoch as YYYY-MM-DD HH:MM:SS in the session's zone; '' for null and 0."""
    return F.when(F.coalesce(epoch_ns, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_micros(F.floor(epoch_ns / 1000)), "yyyy-MM-dd HH:mm:ss"))


def plain_number(c: Column) -> Column:
    """A number or numeric text as double, without thousands commas or other leniency; null otherwise."""
    return F.trim(c.cast("string")).try_cast("double")


def json_path(meta: Column, path: str) -> Column:
    """The text at a dotted path of a JSON document; empty parts count for nothing."""
    return F.get_json_object(meta, "$" + "".join(f"['{p}']" for p in path.split(".") if p))


def either_case(columns: list[str], key: str) -> Column:
    """The trimmed value of a column whatever the case of its name: as given, lower, upper; '' if there is none."""
    found = [F.col(f"`{v}`") for v in dict.fromkeys((key, key.lower(), key.upper())) if v in columns]
    return F.coalesce(*(F.trim(c.cast("string")) for c in found), F.lit("")) if found else F.lit("")


def ignored_path(path: Column, ignored: list[str]) -> Column:
    """Whether any part of a path has an ignored name, whatever the case."""
    parts = F.split(F.lower(path), r"[/\\]+")
    return F.coalesce(F.arrays_overlap(parts, F.array(*(F.lit(x.lower()) for x in ignored))), F.lit(False)) if ignored else F.lit(False)


def first_existing(candidates: list[Column], existing: Column) -> Column:
    """The first of several paths that is in ``existing`` (an array), else null."""
    return F.coalesce(*(F.when(F.array_contains(existing, c), c) for c in candidates))


def short_aliases(aliases: list[str], always: tuple[str, ...] = ("td",)) -> tuple[list[str], list[str]]:
    """(whole tokens, parts of text): single words of at most three letters must be whole tokens."""
    plain = sorted({" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in a.lower()).split()) for a in aliases} - {""})
    short = [a for a in plain if len(a) <= 3 and " " not in a]
    return sorted({*short, *always}), [a for a in plain if a not in short]


def is_test_data(document_type: Column, acronym: Column, paths: list[Column], aliases: list[str]) -> Column:
    """Whether a document is a test data report: its type or acronym is an alias, or its paths hold one (short ones as whole words)."""
    short, long = short_aliases(aliases or ["Test Data", "Test-Data", "TestData", "TD"])
    names = F.array(*map(F.lit, [*short, *long]))
    blob = S.alnum_spaces(F.concat_ws(" ", *paths))
    inside = reduce(lambda a, b: a | b, [F.contains(blob, F.lit(a)) for a in long], F.lit(False))
    return F.array_contains(names, fact_text(document_type)) | F.array_contains(names, fact_text(acronym)) | inside | F.arrays_overlap(F.split(blob, " "), F.array(*map(F.lit, short)))
