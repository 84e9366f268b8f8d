"""Scalar functions with MySQL results as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED = "decimal(20,0)"
_BASE = 1 << 64


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truth(c: Column) -> Column:
    """A boolean as MySQL shows it: 1, 0 or NULL."""
    return c.cast("int")


def number(s: Column) -> Column:
    """The number that a string begins with, as a double; 0 without one."""
    found = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(s.isNull(), None).when(found == "", 0.0).otherwise(found.try_cast("double"))


def divide(a: Column, b: Column, scale: int = 4) -> Column:
    """`/`: an exact decimal; NULL for a zero divisor. scale is four more digits than a has, 6 at most."""
    exact = lambda c: c.cast("decimal(30,10)")
    return F.when(b != 0, F.round(exact(a) / F.nullif(exact(b), exact(F.lit(0))), scale)).cast(f"decimal(30,{scale})")


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def mod(a: Column, b: Column) -> Column:
    return F.call_function("try_mod", a, b)


def xor(a: Column, b: Column) -> Column:
    return truth((a != 0) != (b != 0))


def bits(c: Column) -> Column:
    """A number as a 64-bit pattern; unsigned ones from 2 ** 63 become negative."""
    c = c.cast(UNSIGNED)
    high = c >= F.lit(str(_BASE // 2)).cast(UNSIGNED)
    return F.when(high, c - F.lit(str(_BASE)).cast(UNSIGNED)).otherwise(c).cast("bigint")


def unsigned(c: Column) -> Column:
    """A 64-bit pattern read as unsigned."""
    c = bits(c)
    return F.when(c < 0, c.cast(UNSIGNED) + F.lit(str(_BASE)).cast(UNSIGNED)).otherwise(c.cast(UNSIGNED)).cast(UNSIGNED)


def bit_not(c: Column) -> Column:
    return unsigned(F.bitwise_not(bits(c)))


def shift_left(c: Column, n: Column) -> Column:
    """`<<`: bits past the 64th are lost, shifts of 64 and more give 0."""
    n = n.cast("int")
    return F.when((n < 0) | (n >= 64), F.lit(0).cast(UNSIGNED)).otherwise(unsigned(F.call_function("shiftleft", bits(c), n)))


def shift_right(c: Column, n: Column) -> Column:
    n = n.cast("int")
    return F.when((n < 0) | (n >= 64), F.lit(0).cast(UNSIGNED)).otherwise(unsigned(F.call_function("shiftrightunsigned", bits(c), n)))


def _strict(f, args) -> Column:
    missing = F.lit(False)
    for a in args:
        missing = missing | a.isNull()
    return F.when(~missing, f(*args))


def greatest(*args: Column) -> Column:
    """NULL if any argument is."""
    return _strict(F.greatest, args)


def least(*args: Column) -> Column:
    return _strict(F.least, args)


def ci(s: Column) -> Column:
    """A string under the default case- and accent-insensitive collation."""
    return F.collate(s, "UNICODE_CI_AI")


def like(s: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE without regard to case and accents: both sides lose their combining marks first."""
    return F.like(F.collate(plain(s), "UTF8_LCASE"), plain(F.lit(pattern)), F.lit(escape))


#: Letters with a mark, and the same letters without (fixed values).
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def plain(s: Column) -> Column:
    """A string with the marks of Latin letters taken off."""
    return F.translate(s, _MARKED + _MARKED.upper().replace("Ÿ", "Ÿ"), _PLAIN + _PLAIN.upper())


def regexp(s: Column, pattern: str) -> Column:
    return s.rlike(f"(?i){pattern}")


def substring(s: Column, pos: Column, length: Column | None = None) -> Column:
    """Positions count from 1, or from the end if negative; 0 and positions outside give ''."""
    length = F.char_length(s) if length is None else length
    inside = (pos != 0) & (pos >= -F.char_length(s)) & (length > 0)
    return F.when(s.isNull() | pos.isNull() | length.isNull(), None).when(inside, F.substring(s, pos.cast("int"), F.greatest(length, F.lit(0)).cast("int"))).otherwise("")


def pad(s: Column, n: Column, p: Column, left: bool) -> Column:
    """LPAD and RPAD: NULL for a negative length, '' if an empty pad would be needed."""
    f = "lpad" if left else "rpad"
    return F.when(n < 0, None).when((F.char_length(p) == 0) & (n > F.char_length(s)), "").otherwise(F.call_function(f, s, n.cast("int"), p))


def trim(s: Column, what: str, side: str = "both") -> Column:
    """TRIM(side what FROM s): whole repetitions of `what`."""
    if not what:
        return s
    one = "(?:" + "".join("\\" + c if not c.isalnum() else c for c in what) + ")+"
    if side in ("both", "leading"):
        s = F.regexp_replace(s, "^" + one, "")
    return F.regexp_replace(s, one + "$", "") if side in ("both", "trailing") else s


def strcmp(a: Column, b: Column) -> Column:
    a, b = ci(a), ci(b)
    return F.when(a == b, 0).when(a < b, -1).when(a > b, 1)


def field(s: Column, *values: Column) -> Column:
    """1-based place of s among values, by collation; 0 if it is NULL or missing."""
    out = F.when(s.isNull(), 0)
    for i, v in enumerate(values):
        out = out.when(ci(s) == ci(v), i + 1)
    return out.otherwise(0)


def find_in_set(s: Column, some: Column) -> Column:
    return F.find_in_set(ci(s), ci(some))


def locate(sub: Column, s: Column, pos: int = 1) -> Column:
    """LOCATE, POSITION and INSTR: 1-based, by collation; 0 if it isn't there from pos on."""
    lower = lambda c: F.lower(plain(c))
    found = F.call_function("locate", lower(sub), lower(s), F.lit(pos))
    return F.when(sub.isNotNull() & s.isNotNull(), found)


def elt(n: Column, *values: Column) -> Column:
    return F.when((n >= 1) & (n <= len(values)), F.get(F.array(*values), (n - 1).cast("int")))


def insert(s: Column, pos: Column, length: Column, new: Column) -> Column:
    """INSERT(): s itself if pos is outside; a length outside reaches to the end."""
    n = F.char_length(s)
    rest = F.when((length < 0) | (pos + length > n), n + 1).otherwise(pos + length)
    return F.when((pos < 1) | (pos > n), s).otherwise(F.concat(F.substring(s, F.lit(1), (pos - 1).cast("int")), new, F.substring(s, rest.cast("int"), n)))


def make_set(bits: Column, *values: Column) -> Column:
    some = [F.when(bits.bitwiseAND(1 << i) != 0, v) for i, v in enumerate(values)]
    return F.when(bits.isNotNull(), F.array_join(F.array_compact(F.array(*some)), ","))


def export_set(value: Column, on: str, off: str, sep: str = ",", n: int = 64) -> Column:
    """EXPORT_SET: the lowest n bits, lowest first; an n outside 0 to 64 means 64."""
    n = n if 0 <= n <= 64 else 64
    each = [F.when(F.shiftright(bits(value), i).bitwiseAND(1) == 1, on).otherwise(off) for i in range(n)]
    return F.when(value.isNotNull(), F.array_join(F.array(*each), sep) if n else F.lit(""))


def ord_(s: Column) -> Column:
    """The bytes of the first character as one number."""
    return F.when(s == "", 0).otherwise(F.conv(F.hex(F.encode(F.left(s, F.lit(1)), "UTF-8")), 16, 10).cast("bigint"))


def quote(s: Column) -> Column:
    safe = s
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\x1a", "\\Z")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), safe, F.lit("'")), F.lit("NULL"))


def from_base64(s: Column) -> Column:
    return F.when(F.regexp_replace(s, r"\s", "").rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(s))


def format_number(x: Column, d: int) -> Column:
    return F.format_number(x, max(d, 0))


def guarded(f, x: Column, inside: Column) -> Column:
    """A math function that is NULL outside its domain."""
    return F.when(inside, f(x))


def to_days(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + 719528


def from_days(n: Column) -> Column:
    """NULL before the year 1, which a date can't hold."""
    return F.when(n >= 366, F.date_add(F.lit("1970-01-01").cast("date"), (n - 719528).cast("int")))


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def period_add(p: Column, n: Column) -> Column:
    months = F.call_function("div", p, F.lit(100)) * 12 + p % 100 - 1 + n
    return F.call_function("div", months, F.lit(12)) * 100 + months % 12 + 1


def period_diff(a: Column, b: Column) -> Column:
    m = lambda p: F.call_function("div", p, F.lit(100)) * 12 + p % 100
    return m(a) - m(b)


def _week(d: Column, mode: int) -> tuple[Column, Column, Column, Column]:
    monday, first = mode & 1, mode & 4
    first = not first if not monday else bool(first)
    wd = (lambda x: F.weekday(x)) if monday else (lambda x: F.dayofweek(x) - 1)

    def start(y: Column) -> Column:
        j = F.make_date(y, F.lit(1), F.lit(1))
        w = wd(j)
        return F.date_add(j, F.when(w == 0, 0).otherwise(7 - w) if first else F.when(w < 4, -w).otherwise(7 - w))

    y = F.year(d)
    number = lambda s: F.floor(F.datediff(d, s) / 7) + 1
    before, after = d < start(y), d >= start(y + 1)
    year = F.when(before, y - 1).when(after, y + 1).otherwise(y)
    full = F.when(before, number(start(y - 1))).when(after, 1).otherwise(number(start(y)))
    return year, full, F.when(before, 0).otherwise(number(start(y))), before


def week(d: Column, mode: int = 0) -> Column:
    """WEEK() in its eight modes."""
    mode &= 7
    _, full, plain, _ = _week(d, mode)
    return (full if mode & 2 else plain).cast("int")


def yearweek(d: Column, mode: int = 0) -> Column:
    year, full, _, _ = _week(d, mode & 7)
    return (year * 100 + full).cast("int")


#: DATE_FORMAT tokens with a Java pattern (fixed values); others are built from expressions.
_JAVA = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "p": "a", "W": "EEEE", "a": "EEE", "M": "MMMM", "b": "MMM", "f": "SSSSSS", "j": "DDD", "r": "hh:mm:ss a", "T": "HH:mm:ss"}


def date_format(d: Column, fmt: str) -> Column:
    """DATE_FORMAT(d, fmt) for a constant format, week tokens included."""
    parts, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c != "%" or i + 1 == len(fmt):
            parts.append(F.lit(c))
            i += 1
            continue
        t = fmt[i + 1]
        i += 2
        day = F.dayofmonth(d)
        if t in _JAVA:
            parts.append(F.date_format(d, _JAVA[t]))
        elif t == "D":
            end = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
            parts.append(F.concat(day.cast("string"), end))
        elif t == "w":
            parts.append((F.dayofweek(d) - 1).cast("string"))
        elif t in "UuVv":
            parts.append(F.lpad(week(F.to_date(d), {"U": 0, "u": 1, "V": 2, "v": 3}[t]).cast("string"), 2, "0"))
        elif t in "Xx":
            parts.append(_week(F.to_date(d), {"X": 2, "x": 3}[t])[0].cast("string"))
        else:
            parts.append(F.lit(t))
    return F.concat(*parts) if parts else F.lit("")
