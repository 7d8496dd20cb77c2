"""Scalar column functions (all JVM-side built-ins, no Python UDF).

Each function takes and returns ``Column`` so it fuses into whole-stage
codegen wherever it is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as K

# Python's str.strip() removes Unicode white space, Spark's trim only blanks.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
              + "\u2028\u2029\u202f\u205f\u3000")
# str.splitlines() boundaries: Java's \R plus the three separator controls.
LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing white space
    (``btrim`` with the explicit set: no regular expression per row)."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def null_if_token(c, tokens) -> Column:
    """Null when the value is null or equals one of ``tokens``."""
    c = col_(c)
    return F.when(c.isNull() | c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


# --- P2 / P6: identifiers --------------------------------------------------

def line_from_station(station) -> Column:
    """Text before the first ``-`` or ``_``; '' when station is empty."""
    s = col_(station)
    return F.when(s.isNull() | (s == ""), F.lit("")).otherwise(F.split(s, "[-_]", -1).getItem(0))


def track_from_filename(filename) -> Column:
    """Drop extension and the ``ic_``/``IC_`` prefix and ``.rslt``/``_rslt``;
    keep the text before the first ``_`` or ``.``."""
    base = F.regexp_replace(col_(filename), "^(\\.*[^.].*)\\.[^.]*$", "$1")
    base = F.regexp_replace(base, "^(ic_|IC_)", "")
    base = F.replace(F.replace(base, F.lit(".rslt"), F.lit("")), F.lit("_rslt"), F.lit(""))
    return strip_ws(F.split(base, "[_.]", -1).getItem(0))


def is_rslt_name(filename) -> Column:
    """Base name contains ``rslt`` in any case."""
    return F.lower(col_(filename)).contains("rslt")


# --- P5: test-code predicate ---------------------------------------------

def is_testcode(raw) -> Column:
    """P5: does a raw TH4 field look like a failure test code?"""
    val = strip_ws(raw)
    segs = F.split(strip_ws(F.split(val, ";", -1).getItem(0)), "_", -1)
    return (F.coalesce(
        (F.length(val) > 0)
        & ~F.upper(val).isin(*K.TESTCODE_SKIP_VALUES)
        & ~val.startswith("REL.")
        & val.contains("_")
        & ~val.rlike("\\p{Ll}")
        & ~val.rlike("^[A-Z]+-[A-Z]")
        & ~F.element_at(segs, -1).isin(*K.GEO_SUFFIXES)
        & (F.size(segs) >= 3)
        & (val.rlike("\\d{2,}") | val.rlike(K.TESTCODE_KEYWORDS)),
        F.lit(False)))


# --- P3 / P9 / P14: time -------------------------------------------------

_ISO_SHAPE = "^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(\\.\\d{1,6})?$"


def parse_iso_ts(text) -> Column:
    """Strict ``yyyy-MM-dd HH:mm:ss`` with an optional fraction (``T`` also accepted as separator) to
    TIMESTAMP_NTZ; anything else is null. Zone-independent: no session TZ."""
    t = F.replace(F.trim(col_(text)), F.lit("T"), F.lit(" "))
    return F.when(t.rlike(_ISO_SHAPE), t.try_cast("timestamp_ntz"))


def normalized_ts_text(ts="timestamp", date="date", time="time") -> Column:
    """Trim; blank -> date || ' ' || time (null-propagating); ``T`` -> space."""
    t = F.trim(col_(ts))
    filled = F.coalesce(F.when(t != "", t), F.concat(col_(date), F.lit(" "), col_(time)))
    return F.replace(filled, F.lit("T"), F.lit(" "))


_RESULT_TIME = ("^(1[0-2]|0[1-9]|[1-9])/(3[01]|[12]\\d|0[1-9]|[1-9])/(\\d{2}|\\d{4})\\s+"
                "(2[0-3]|[01]\\d|\\d):([0-5]\\d|\\d):([0-5]\\d|\\d)$")


def result_time_parts(text) -> Column:
    """The six numbers (month, day, year, hour, minute, second) of a P3 time
    text, or null when the text does not have the strict shape."""
    t = col_(text)
    return F.when(t.rlike(_RESULT_TIME), F.regexp_extract_all(t, F.lit("(\\d+)"), 1))


def time_from_parts(parts) -> Column:
    """TIMESTAMP_NTZ from ``result_time_parts``; two-digit years 69..99 are
    19xx and 00..68 are 20xx (C ``strptime``); null when the date is invalid."""
    p = col_(parts)
    y = F.get(p, 2)
    yy = y.cast("int")
    year = F.when(F.length(y) == 2, F.when(yy >= 69, yy + 1900).otherwise(yy + 2000)).otherwise(yy)
    return F.try_make_timestamp_ntz(year, F.get(p, 0).cast("int"), F.get(p, 1).cast("int"),
                                    F.get(p, 3).cast("int"), F.get(p, 4).cast("int"),
                                    F.get(p, 5).cast("decimal(8,6)"))


def parse_result_time_ts(text) -> Column:
    """P3 as TIMESTAMP_NTZ: ``%m/%d/%y %H:%M:%S`` then ``%m/%d/%Y %H:%M:%S``
    (C ``strptime`` field rules); null when neither fits. Built from the
    parts, so no session time zone is involved."""
    return time_from_parts(result_time_parts(text))


def parse_result_time(text) -> Column:
    """Normalised text ``yyyy-MM-dd HH:mm:ss`` or null."""
    return F.date_format(parse_result_time_ts(text), "yyyy-MM-dd HH:mm:ss")


def micros_of_day(ts) -> Column:
    """Microsecond of the day of a TIMESTAMP_NTZ (for time-of-day ranges)."""
    ts = col_(ts)
    seconds = F.extract(F.lit("SECOND"), ts)                 # with its fraction, exact
    return (F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60) * 1_000_000 + (seconds * 1_000_000).cast("long")


def time_text_to_micros(text: str) -> int:
    """'HH:MM[:SS]' -> microsecond of day (driver-side constant)."""
    parts = [int(p) for p in text.split(":")] + [0, 0]
    return ((parts[0] * 60 + parts[1]) * 60 + parts[2]) * 1_000_000


# --- P10 / P11 / P12 / P16 / P17: statuses and rates ----------------------

def alert_failed(status="status") -> Column:
    """P10: ``UPPER(TRIM(status)) IN ('F','FAIL','FAILED')``."""
    return F.coalesce(F.upper(F.trim(col_(status))).isin(*K.ALERT_FAIL_STATUSES), F.lit(False))


def primary_code(code="failed_testcode") -> Column:
    """Trimmed text before the first ``;``."""
    return F.trim(F.substring_index(col_(code), ";", 1))


def ntf_code(code) -> Column:
    """Code matches one NTF word (case-insensitive) or is MISSING_CODE."""
    c = col_(code)
    pattern = "(?i)(" + "|".join(K.NTF_PATTERNS) + ")"
    return F.coalesce(c.rlike(pattern) | (c == K.MISSING_CODE), F.lit(False))


def pct(part, total, places: int | None = None) -> Column:
    """Part / total * 100, 0 when total is 0; half-even rounding."""
    raw = F.coalesce(F.try_divide(col_(part).cast("double"), col_(total).cast("double")) * 100,
                     F.lit(0.0))
    return raw if places is None else F.bround(raw, places)


def minutes_between(later, earlier) -> Column:
    """Fractional minutes between two timestamps."""
    return (F.unix_micros(col_(later).cast("timestamp")) -
            F.unix_micros(col_(earlier).cast("timestamp"))) / 60_000_000.0


def decodable(text: Column) -> Column:
    """``text`` without its undecodable bytes. A replacement character that the text itself holds stays: it is
    spelled as a pair of noncharacters while the undecodable bytes are replaced and dropped."""
    mark, own, bad = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"
    spelled = F.replace(F.replace(text, F.lit(mark), F.lit(own)), F.lit("\ufffd"), F.lit(bad))
    clean = F.replace(F.make_valid_utf8(spelled), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(clean, F.lit(bad), F.lit("\ufffd")), F.lit(own), F.lit(mark))
