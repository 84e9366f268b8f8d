"""Date and time functions with MySQL results, as Column expressions. A TIME is a number of microseconds, shown by `time_text`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000
#: The largest TIME (fixed value): 838:59:59.
MAX_TIME = (838 * 3600 + 59 * 60 + 59) * _SECOND


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, F.lit(b))


def timestamp(s: Column) -> Column:
    """TIMESTAMP(s) and CAST(s AS DATETIME): NULL for what isn't one."""
    return s.cast("string").try_cast("timestamp_ntz")


def micros(t: Column) -> Column:
    """Microseconds of a timestamp without a zone since 1970."""
    return F.unix_micros(t.cast("timestamp"))


def _from_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def time_of(s: Column) -> Column:
    """TIME(s): the microseconds of a text [-]h:m[:s[.f]], or of a timestamp's time of day; beyond 838:59:59 that; NULL for others."""
    text = s.cast("string")
    found = lambda i: F.regexp_extract(text, r"^\s*(-?)(?:\d{4}-\d{1,2}-\d{1,2}[ T])?(\d+):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6})\d*)?)?\s*$", i)
    part = lambda i: F.coalesce(F.nullif(found(i), F.lit("")).cast("bigint"), F.lit(0))
    fraction = F.rpad(found(5), 6, "0").cast("bigint")
    size = ((part(2) * 60 + part(3)) * 60 + part(4)) * _SECOND + fraction
    inside = (found(2) != "") & (part(3) < 60) & (part(4) < 60)
    return F.when(inside, F.least(size, F.lit(MAX_TIME)) * F.when(found(1) == "-", -1).otherwise(1))


def time_text(t: Column, digits: int = 0) -> Column:
    """A TIME as [-]hh:mm:ss[.f], hours past 24 too."""
    a = F.abs(t)
    s = _div(a, _SECOND)
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    out = F.concat(F.when(t < 0, "-").otherwise(""), two(_div(s, 3600)), F.lit(":"), two(_div(s, 60) % 60), F.lit(":"), two(s % 60))
    return F.concat(out, F.lit("."), F.left(F.lpad((a % _SECOND).cast("string"), 6, "0"), F.lit(digits))) if digits else out


def clip(t: Column) -> Column:
    return F.greatest(F.least(t, F.lit(MAX_TIME)), F.lit(-MAX_TIME))


def timediff(a: Column, b: Column) -> Column:
    """TIMEDIFF of two timestamps, as a TIME."""
    return clip(micros(a) - micros(b))


def addtime(t: Column, d: Column) -> Column:
    """ADDTIME(timestamp, TIME); SUBTIME with a negative one."""
    return _from_micros(micros(t) + d)


def maketime(h: Column, m: Column, s: Column) -> Column:
    """NULL for minutes or seconds outside 0 to 59."""
    size = (F.abs(h).cast("bigint") * 3600 + m.cast("bigint") * 60) * _SECOND + (s * _SECOND).cast("bigint")
    return F.when(m.between(0, 59) & (s >= 0) & (s < 60), clip(F.when(h < 0, -size).otherwise(size)))


def makedate(y: Column, n: Column) -> Column:
    """The n-th day of a year; NULL for n of 0 and less."""
    return F.when(n > 0, F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (n - 1).cast("int")))


def time_to_sec(t: Column) -> Column:
    return _div(t, _SECOND)


def sec_to_time(n: Column) -> Column:
    return clip((n * _SECOND).cast("bigint"))


def to_seconds(t: Column) -> Column:
    return _div(micros(t), _SECOND) + 719528 * 86400


def unix_timestamp(t: Column) -> Column:
    """Whole seconds since 1970 in the session's zone; 0 before."""
    return F.greatest(_div(F.unix_micros(t.cast("timestamp")), _SECOND), F.lit(0))


def from_unixtime(n: Column) -> Column:
    """NULL for a negative number."""
    return F.when(n >= 0, F.timestamp_micros((n * _SECOND).cast("bigint")).cast("timestamp_ntz"))


#: Units of a fixed length, in microseconds (fixed values).
_FIXED = {"MICROSECOND": 1, "SECOND": _SECOND, "MINUTE": 60 * _SECOND, "HOUR": 3600 * _SECOND, "DAY": 86400 * _SECOND, "WEEK": 7 * 86400 * _SECOND}
_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def timestampadd(unit: str, n: Column, t: Column) -> Column:
    """Days past a month's end become its last."""
    unit = unit.upper()
    if unit in _FIXED:
        return _from_micros(micros(t) + n.cast("bigint") * _FIXED[unit])
    return t + F.make_ym_interval(F.lit(0), (n * _MONTHS[unit]).cast("int"))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units from a to b, towards zero."""
    unit = unit.upper()
    if unit in _FIXED:
        return _div(micros(b) - micros(a), _FIXED[unit])
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    inside = lambda t: (F.dayofmonth(t).cast("bigint") - 1) * 86400 * _SECOND + micros(t) - micros(F.date_trunc("day", t).cast("timestamp_ntz"))
    late, early = inside(b) < inside(a), inside(b) > inside(a)
    whole = F.when((months > 0) & late, months - 1).when((months < 0) & early, months + 1).otherwise(months)
    return _div(whole, _MONTHS[unit])


#: The fields of composite units, largest first, and the digits that a later one takes (fixed values).
_COMPOSITE = {
    "YEAR_MONTH": ("year", "month"),
    "DAY_HOUR": ("day", "hour"),
    "DAY_MINUTE": ("day", "hour", "minute"),
    "DAY_SECOND": ("day", "hour", "minute", "second"),
    "DAY_MICROSECOND": ("day", "hour", "minute", "second", "microsecond"),
    "HOUR_MINUTE": ("hour", "minute"),
    "HOUR_SECOND": ("hour", "minute", "second"),
    "HOUR_MICROSECOND": ("hour", "minute", "second", "microsecond"),
    "MINUTE_SECOND": ("minute", "second"),
    "MINUTE_MICROSECOND": ("minute", "second", "microsecond"),
    "SECOND_MICROSECOND": ("second", "microsecond"),
}
_FIELD = {
    "YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "WEEK": F.weekofyear, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
}


def microsecond(t: Column) -> Column:
    return F.pmod(micros(t), F.lit(_SECOND))


def extract(unit: str, t: Column) -> Column:
    """EXTRACT(unit FROM t): a composite unit's fields stand one after another, two digits each, microseconds six."""
    unit = unit.upper()
    if unit == "WEEK":
        from .dialect import week

        return week(F.to_date(t), 0).cast("bigint")
    one = lambda u: microsecond(t) if u == "MICROSECOND" else _FIELD[u](t).cast("bigint")
    if unit not in _COMPOSITE:
        return one(unit)
    out = F.lit(0).cast("bigint")
    for u in _COMPOSITE[unit]:
        out = out * (_SECOND if u == "microsecond" else 100) + one(u.upper())
    return out


#: STR_TO_DATE letters: the pattern that they read (fixed values).
_READ = {"Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "c": r"(\d{1,2})", "d": r"(\d{1,2})", "e": r"(\d{1,2})", "H": r"(\d{1,2})", "k": r"(\d{1,2})", "h": r"(\d{1,2})", "I": r"(\d{1,2})", "l": r"(\d{1,2})", "i": r"(\d{1,2})", "s": r"(\d{1,2})", "S": r"(\d{1,2})", "f": r"(\d{1,6})", "p": r"([AaPp][Mm])", "M": r"([A-Za-z]+)", "b": r"([A-Za-z]+)", "j": r"(\d{1,3})"}
_AS = {"c": "m", "e": "d", "k": "H", "I": "h", "l": "h", "S": "s", "b": "M", "T": "H:i:s"}


def str_to_date(s: Column, fmt: str) -> Column:
    """STR_TO_DATE for a constant format: a timestamp, NULL where the text doesn't match or there is no such day."""
    import re

    fmt = fmt.replace("%T", "%H:%i:%s").replace("%r", "%h:%i:%s %p")
    pattern, names, i = "", [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            pattern += _READ.get(fmt[i + 1], re.escape(fmt[i + 1]))
            if fmt[i + 1] in _READ:
                names.append(_AS.get(fmt[i + 1], fmt[i + 1]))
            i += 2
        else:
            pattern += r"\s*" if fmt[i] == " " else re.escape(fmt[i])
            i += 1
    found = {n: F.regexp_extract(s, "^" + pattern, k + 1) for k, n in enumerate(names)}
    n = lambda k, other: found[k].try_cast("int") if k in found else F.lit(other)
    year = n("Y", 1970) if "Y" in found or "y" not in found else F.when(n("y", 0) < 70, n("y", 0) + 2000).otherwise(n("y", 0) + 1900)
    months = "january february march april may june july august september october november december".split()
    month = n("m", 1)
    if "M" in found:
        month = F.lit(None).cast("int")
        for k, m in reversed(list(enumerate(months, 1))):
            month = F.when(F.lower(found["M"]).isin(m, m[:3]), k).otherwise(month)
    hour = n("H", 0)
    if "h" in found:
        hour = n("h", 0) % 12 + (F.when(F.lower(found["p"]) == "pm", 12).otherwise(0) if "p" in found else 0)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%s", year, month, n("d", 1), hour, n("i", 0), n("s", 0), F.rpad(found["f"], 6, "0") if "f" in found else F.lit("000000"))
    out = F.when(s.rlike("^" + pattern) & month.isNotNull(), text.try_cast("timestamp_ntz"))
    return out + F.make_dt_interval(days=n("j", 1) - 1) if "j" in found else out


#: GET_FORMAT (fixed values).
FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}


def get_format(kind: str, place: str) -> str | None:
    kind = kind.upper()
    return FORMATS.get(("DATETIME" if kind == "TIMESTAMP" else kind, place.upper()))


def convert_tz(t: Column, a: str, b: str) -> Column:
    return F.convert_timezone(F.lit(a), F.lit(b), t.cast("timestamp_ntz"))
