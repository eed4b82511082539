"""Scalar expressions. Everything here is a built-in Column expression: it fuses into the stage it is used in,
and it also works on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text strip removes at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Patterns.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
# Marks that stand for a cell which cannot be compared.
NAN_MARK = "__NAN__"
INVALID_MARK = "__INVALID__"
BAD_DATE_MARK = "__BAD_DATE__"
INVALID_DATE_MARK = "__INVALID_DATE__"
MISSING_ROW_MARK = "__MISSING__"
MISSING_COLUMN_MARK = "__MISSING_COL__"
# Plausible years, and years whose every day a nanosecond timestamp can hold, also as patterns.
FIRST_YEAR, LAST_YEAR = 2000, 2030
PLAUSIBLE_YEARS = "20[0-2][0-9]|2030"
HELD_YEARS = "167[89]|16[89][0-9]|1[7-9][0-9]{2}|2[01][0-9]{2}|22[0-5][0-9]|226[01]"

# Rewriting of date forms to y-m-d, tried in order. US order wins over European order for slashes: a first
# part above 12 cannot be a month, and one up to 12 leaves no second reading that is a valid date.
STRICT_DATE_FORMS: tuple[tuple[str, str], ...] = (
    (r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})$", "$1-$3-$4"),
    (r"^(0?[1-9]|1[0-2])/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2"),
    (r"^([0-9]{1,2})([./])([0-9]{1,2})\2([0-9]{4})$", "$4-$3-$1"),
)
# The same for a free guess, month first wherever that is possible.
GUESSED_DATE_FORMS: tuple[tuple[str, str], ...] = (
    (r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1"),
    (r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$", "$1-$3-$4"),
    (r"^(0?[1-9]|1[0-2])([-/.])([0-9]{1,2})\2([0-9]{4})$", "$4-$1-$3"),
    (r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})$", "$4-$3-$1"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
    (r"^([0-9]{1,2})/([0-9]{4})$", "$2-$1-01"),
    (r"^([0-9]{4})$", "$1-01-01"),
    (r"^([0-9]{4}-[0-9]{1,2})$", "$1-01"),
)
_MONTH = (
    "(?=(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?"
    "|Nov(?:ember)?|Dec(?:ember)?)[^a-z])([a-z]{3})[a-z]*"
)
# Forms with a month name, rewritten to "day month year".
MONTH_NAME_FORMS: tuple[tuple[str, str], ...] = (
    (rf"(?i)^{_MONTH} ([0-9]{{1,2}}),? ([0-9]{{4}})$", "$2 $1 $3"),
    (rf"(?i)^([0-9]{{1,2}})[ -]{_MONTH}[ -]([0-9]{{4}})$", "$1 $2 $3"),
    (rf"(?i)^{_MONTH} ([0-9]{{4}})$", "1 $1 $2"),
)


# -- text ------------------------------------------------------------------------------------------------------

def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_stripped(c: Column) -> Column:
    return c == strip(c)


def as_text(c: Column) -> Column:
    return c.cast("string")


def zero_padded(c: Column, width: int) -> Column:
    """Left-pad with zeros; longer texts stay whole."""
    t = as_text(c)
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def lookup(mapping: Mapping[str, str], key: Column, default: Column | None = None) -> Column:
    """Value of a fixed map, or the default where the key is absent."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, default)


def coalesce_first(cols: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])


# -- missing and numbers -----------------------------------------------------------------------------------------

def is_missing(c: Column, floating: bool = False) -> Column:
    """NULL, and NaN for floating-point columns. Empty text and words such as 'N/A' are values."""
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _number(text: Column) -> Column:
    """The guard keeps words away from the cast, which is slow to refuse them; what overflows to infinity is no number."""
    x = text.try_cast("double")
    return F.when(text.rlike(NUMBER_PATTERN) & (F.abs(x) < float("inf")), x)


def to_numeric(c: Column) -> Column:
    """Number in a text cell, else NULL; thousands separators do not count as numbers."""
    return _number(strip(as_text(c)))


def safe_float(c: Column) -> Column:
    """Like `to_numeric` but commas are dropped first."""
    return _number(F.replace(strip(as_text(c)), F.lit(","), F.lit("")))


def try_int(c: Column) -> Column:
    return F.regexp_extract(strip(as_text(c)), INTEGER_PATTERN, 0).try_cast("bigint")


def round2(c: Column) -> Column:
    """Two places, ties to even on the scaled value; the addition turns -0.0 into 0.0."""
    return F.rint(c * 100.0) / 100.0 + F.lit(0.0)


def round4(c: Column) -> Column:
    return F.rint(c * 10000.0) / 10000.0 + F.lit(0.0)


def clip(c: Column, low, high) -> Column:
    """NULL stays NULL (`greatest` and `least` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def two_places(x: Column) -> Column:
    """Text with exactly two decimals."""
    return F.coalesce(as_text(round2(x).try_cast("decimal(38,2)")), as_text(x))


def numeric_text(c: Column) -> Column:
    """Comparable text of a numeric cell."""
    return F.when(c.isNull(), F.lit(NAN_MARK)).otherwise(
        F.coalesce(two_places(safe_float(c)), F.lit(INVALID_MARK))
    )


# -- dates -------------------------------------------------------------------------------------------------------

def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _rewritten(text: Column, forms: Sequence[tuple[str, str]]) -> Column:
    for pattern, form in forms:
        text = F.regexp_replace(text, pattern, form)
    return text


def _ymd(text: Column, years: str) -> Column:
    """Date of a y-m-d text whose year matches the pattern; an empty text is no date."""
    return F.regexp_extract(text, f"^(?:{years})-[0-9]{{1,2}}-[0-9]{{1,2}}$", 0).try_cast("date")


def _in_forms(text: Column, forms: Sequence[tuple[str, str]], years: str) -> Column:
    """ISO texts, by far the most common form, skip the rewriting."""
    return _ymd(F.when(text.rlike(ISO_DATE_PATTERN), text).otherwise(_rewritten(text, forms)), years)


def strict_date(c: Column, years: str = HELD_YEARS) -> Column:
    """Date in one of the forms y-m-d, m/d/y, d.m.y, d/m/y, y/m/d."""
    return _in_forms(c, STRICT_DATE_FORMS, years)


def guessed_date(c: Column, years: str = HELD_YEARS) -> Column:
    """Date in one of the freer forms, month first where both orders are possible."""
    named = F.regexp_extract(_rewritten(c, MONTH_NAME_FORMS), f"(?i)^[0-9]{{1,2}} [a-z]{{3}} (?:{years})$", 0)
    spelt = F.when(c.rlike("(?i)[a-z]{3}.*[0-9]{4}$"), F.try_to_date(named, "d MMM y"))
    return F.coalesce(_in_forms(c, GUESSED_DATE_FORMS, years), spelt)


def normalise_dates(c: Column) -> Column:
    """ISO text of a date cell; a guess must fall in the plausible years, anything else stays as it is."""
    text = strip(as_text(c))
    return F.coalesce(as_text(strict_date(text)), as_text(guessed_date(text, PLAUSIBLE_YEARS)), c)


def date_text(c: Column) -> Column:
    """Comparable text of a date cell."""
    day = as_text(guessed_date(strip(as_text(c))))
    return F.coalesce(
        F.when(c.isNull(), F.lit(NAN_MARK)),
        F.regexp_replace(day, f"^(?!(?:{PLAUSIBLE_YEARS})-).*$", BAD_DATE_MARK),
        F.lit(INVALID_DATE_MARK),
    )


def is_iso(c: Column) -> Column:
    return strip(c).rlike(ISO_DATE_PATTERN)


def year_prefix(c: Column) -> Column:
    """The first four characters as a year, NULL where they are no integer."""
    return try_int(F.substring(strip(c), 1, 4))


def valid_iso(c: Column) -> Column:
    """ISO form and a plausible year; false for a missing cell."""
    return F.coalesce(strip(c).rlike(f"^(?:{PLAUSIBLE_YEARS})-[0-9]{{2}}-[0-9]{{2}}$"), F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def add_days(day: Column, n: Column) -> Column:
    return F.date_add(day, n)


# -- lists -------------------------------------------------------------------------------------------------------

def issue_array(*items: tuple[Column, str]) -> Column:
    """['3_missing', ...]: one entry per (count, suffix) whose count is above zero."""
    return F.array_compact(F.array(*[F.when(n > 0, F.concat(as_text(n), F.lit("_" + s))) for n, s in items]))
