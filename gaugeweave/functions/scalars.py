"""Scalar column functions: normalisers, number and requirement parsers, identities, dates, boxes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def strip(c: Column) -> Column:
    """Both ends, any white space; plain trim takes blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case, single blanks, trimmed."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def normalize_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def alnum_spaces(c: Column) -> Column:
    """Lower-case letters and digits, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_header(c: Column) -> Column:
    """Header text without what stands in parentheses."""
    return normalize_text(F.regexp_replace(c, r"\([^)]*\)", ""))


def safe_identifier(c: Column, default: str = "col") -> Column:
    """Letters, digits and underscores, no digit in front, at most 80 characters."""
    s = F.regexp_replace(F.regexp_replace(strip(c), "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", F.lit(default)).otherwise(s)
    return F.substring(F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s), 1, 80)


def finite_number(c: Column) -> Column:
    """Number or numeric text with thousands commas; anything else, NaN and infinities are null."""
    s = F.regexp_replace(F.trim(c.cast("string")), ",", "")
    return F.when(s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.expr("0") + s.try_cast("double"))


def strict_number(c: Column) -> Column:
    """As :func:`finite_number`, but a digit must lead: '.5' is text."""
    return F.when(F.trim(c.cast("string")).rlike("^[+-]?[0-9]"), finite_number(c))


def first_number(c: Column) -> Column:
    """The first number in a text."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"[+-]?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def is_missing(c: Column) -> Column:
    return c.isNull() | (F.lower(F.trim(c)).isin("", "unknown"))


def is_numeric_like(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^\(?[+-]?[0-9]+(\.[0-9]+)?%?\)?$|^[0-9.]+ *(-|to) *[0-9.]+$"), F.lit(False))


def is_range_like(c: Column) -> Column:
    """'20-30' but not '-40'."""
    return F.coalesce(F.trim(c).rlike(r"^[0-9]+(\.[0-9]+)? *(-|–|to) *[+-]?[0-9]+(\.[0-9]+)?"), F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def stat_alias(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z]", "")
    return F.when(s.isin("avg", "average"), "mean").when(s.isin("stdev", "stddev", "standarddeviation"), "std").otherwise(s)


def requirement(c: Column) -> Column:
    """struct(type, min, max) of a requirement text; a lone number is a maximum, and decimal commas read as points."""
    s = F.regexp_replace(F.trim(c), ",", ".")
    n = lambda pattern, group: F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast("double")
    ranged, le, lt_left, ge, ge_left, bare = rf"^({NUMBER}) *(?:-|–|to) *({NUMBER})", rf"^(?:<=|≤|<) *({NUMBER})", rf"^({NUMBER}) *(?:<=|≤|<)", rf"^(?:>=|≥|>) *({NUMBER})", rf"^({NUMBER}) *(?:>=|≥|>)", rf"^({NUMBER})"
    null = F.lit(None).cast("double")
    made = lambda kind, low, high: F.struct(F.lit(kind).alias("type"), low.alias("min"), high.alias("max"))
    return (
        F.when(s.rlike(ranged), made("range", n(ranged, 1), n(ranged, 2))).when(s.rlike(lt_left), made("max", null, n(lt_left, 1))).when(s.rlike(le), made("max", null, n(le, 1)))
        .when(s.rlike(ge_left), made("min", n(ge_left, 1), null)).when(s.rlike(ge), made("min", n(ge, 1), null)).when(s.rlike(bare), made("max", null, n(bare, 1))).otherwise(made("unknown", null, null))
    )


def requirement_range(c: Column) -> Column:
    """struct(min, max) for workbook limits; here a lone number is a minimum."""
    r = requirement(c)
    bare = F.trim(c).rlike(rf"^{NUMBER}$")
    return F.struct(F.when(bare, r["max"]).otherwise(r["min"]).alias("min"), F.when(~bare, r["max"]).alias("max"))


def passes(req: Column, measured: Column) -> Column:
    """Whether a measured value meets a requirement: null if not measured, true if the requirement is unknown."""
    ok = F.when(req["type"] == "range", measured.between(req["min"], req["max"])).when(req["type"] == "max", measured <= req["max"]).when(req["type"] == "min", measured >= req["min"]).when(req["type"] == "exact", F.abs(measured - req["min"]) < 0.001).otherwise(F.lit(True))
    return F.when(measured.isNotNull(), ok)


def measured_value(c: Column) -> Column:
    """struct(value, note): the first number, brackets dropped, and what stands after it."""
    s = F.trim(F.regexp_replace(c, r"[\[\]]", ""))
    value = F.nullif(F.regexp_extract(s, NUMBER, 0), F.lit("")).try_cast("double")
    note = F.trim(F.regexp_replace(F.regexp_extract(s, rf"{NUMBER}(.*)$", 1), r"^[ (]+|[ )]+$", ""))
    return F.struct(value.alias("value"), F.nullif(note, F.lit("")).alias("note"))


def serial_number(c: Column) -> Column:
    """SN and at least four digits, from 'SN7', 's/n 0007' and the like."""
    digits = F.regexp_extract(F.upper(c), r"S/?N[-_ :]*0*([0-9]+)", 1)
    return F.when(digits != "", F.concat(F.lit("SN"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)))


def revision(c: Column) -> Column:
    """One or two letters, upper case."""
    s = F.upper(F.trim(c))
    return F.when(s.rlike("^[A-Z]{1,2}$"), s)


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD from 20YY-M-D or M-D-20YY with any of - / . between; months and days are not validated."""
    ymd, mdy = r"^(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.](20[0-9]{2})$"
    s = F.trim(c)
    part = lambda p, g: F.regexp_extract(s, p, g)
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(s.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(part(ymd, 2)), two(part(ymd, 3)))).when(s.rlike(mdy), F.concat_ws("-", part(mdy, 3), two(part(mdy, 1)), two(part(mdy, 2))))


def split_instance(c: Column) -> Column:
    """struct(term, n) of 'Torque (2)'; n is null without a suffix."""
    pattern = r"^(.*\S)\s*\(([0-9]+)\)\s*$"
    has = c.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(c, pattern, 1)).otherwise(strip(c)).alias("term"), F.when(has, F.regexp_extract(c, pattern, 2).cast("int")).alias("n"))


def excel_column(n: Column) -> Column:
    """Letters of a 1-based column number up to 18,278."""
    z = n - 1
    letter = lambda v: F.chr((v % 26) + 65)
    return F.when(z < 26, letter(z)).when(z < 702, F.concat(letter(F.floor(z / 26) - 1), letter(z))).otherwise(F.concat(letter(F.floor((z - 702) / 676)), letter(F.floor((z - 702) / 26)), letter(z - 702)))


def heal_number(c: Column) -> Column:
    """Numeric look-alikes mended: O to 0, I and l to 1, the minus sign, thousands commas; only if a number results."""
    s = F.regexp_replace(F.translate(F.trim(c), "OoIl−–", "0011--"), r"(?<=\d),(?=\d{3}(\D|$))", "")
    return F.when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?%?$"), s).otherwise(c)


def heal_spacing(c: Column) -> Column:
    """'1 to4' and '12psi' get their blanks; scientific notation stays."""
    s = F.regexp_replace(c, r"(?i)\bto(?=\d)", "to ")
    return F.regexp_replace(s, r"(?<=\d)(?=(?:psi|kohm|ohm|mm|cm|kg|lbf|deg)\b)", " ")


def strip_cell_border(c: Column) -> Column:
    """Border punctuation in front of a cell's text dropped."""
    return F.trim(F.regexp_replace(c, r"^[\s|_\[\]{}!:;]+(?=\S)", ""))


def overlap_share(a: tuple, b: tuple) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) as a share of the first's area."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when((w > 0) & (h > 0) & (area > 0), w * h / area).otherwise(0.0)


def grade(z: Column, pass_max: float = 2.0, watch_max: float = 3.0) -> Column:
    return F.when(F.abs(z) <= pass_max, "PASS").when(F.abs(z) <= watch_max, "WATCH").otherwise("FAIL")


def like_prefix(c: Column, prefix: str) -> Column:
    """Prefix test whatever the case."""
    return F.lower(c).startswith(prefix.lower())
