"""Numeric, cast, control-flow, string and identifier functions with MySQL results, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import UNSIGNED, bits, ci, number, plain, unsigned

# numbers
def round_half_up(x: Column, d: int = 0) -> Column:
    """ROUND of exact and approximate numbers: halves go away from zero; d may be negative."""
    return F.round(x, d)


def truncate(x: Column, d: int) -> Column:
    """TRUNCATE: digits after the d-th are cut off, towards zero."""
    exact = x.cast("decimal(38,12)")
    if d >= 0:
        return F.when(exact < 0, F.call_function("ceil", exact, F.lit(d))).otherwise(F.call_function("floor", exact, F.lit(d)))
    unit = F.lit(10**-d).cast("decimal(20,0)")
    return F.call_function("div", exact, unit) * unit


def acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def asin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log(base: Column, x: Column) -> Column:
    """LOG(b, x): NULL for a base of at most 0 or of 1, or an x of at most 0."""
    return F.when((base > 0) & (base != 1) & (x > 0), F.ln(x) / F.ln(base))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def cot(x: Column) -> Column:
    """An error where the tangent is 0, as an overflow."""
    return F.when(F.tan(x) == 0, F.raise_error(F.lit("1690: DOUBLE value is out of range in 'cot'")).cast("double")).otherwise(1 / F.tan(x))


def exp(x: Column) -> Column:
    return F.when(F.exp(x) == float("inf"), F.raise_error(F.lit("1690: DOUBLE value is out of range in 'exp'")).cast("double")).otherwise(F.exp(x))


def conv(x: Column, a: int, b: int) -> Column:
    """CONV: NULL for a base outside 2 to 36; a negative target base gives a signed result."""
    if not (2 <= abs(a) <= 36 and 2 <= abs(b) <= 36):
        return F.lit(None).cast("string")
    return F.conv(x.cast("string"), a, b)


def oct_(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def bit_count(x: Column) -> Column:
    return F.bit_count(bits(x))


def crc32(x: Column) -> Column:
    return F.crc32(x.cast("string").cast("binary"))


def interval(n: Column, *bounds: Column) -> Column:
    """INTERVAL(n, a, b, ...): how many of the ascending bounds n reaches; -1 for NULL."""
    out = F.when(n.isNull(), -1)
    for i, b in enumerate(bounds):
        out = out.when(n < b, i)
    return out.otherwise(len(bounds))


# control flow
def if_(condition: Column, a: Column, b: Column) -> Column:
    """A NULL condition is false."""
    return F.when(condition, a).otherwise(b)


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def is_null(a: Column) -> Column:
    return a.isNull().cast("int")


def is_true(x: Column) -> Column:
    """The truth of a number: it isn't 0."""
    return (F.coalesce(x, F.lit(0)) != 0).cast("int")


# casts
def cast_signed(s: Column) -> Column:
    """CAST(string AS SIGNED): the integer it begins with, kept within 64 bits."""
    found = F.regexp_extract(s, r"^\s*([+-]?\d+)", 1)
    wide = F.when(F.length(found) > 30, F.lit("9" * 30)).otherwise(F.when(found == "", "0").otherwise(found)).cast("decimal(38,0)")
    edge = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    return F.when(s.isNotNull(), F.greatest(F.least(wide, edge((1 << 63) - 1)), edge(-(1 << 63)))).cast("bigint")


def cast_unsigned(x: Column) -> Column:
    """CAST(number AS UNSIGNED): a negative one's 64-bit pattern."""
    return unsigned(F.round(x.cast("decimal(38,10)"), 0).cast("decimal(20,0)"))


def cast_decimal(s: Column, p: int = 10, d: int = 0) -> Column:
    """CAST(x AS DECIMAL(p, d)): rounded; beyond the range, the largest or least value."""
    edge = F.lit("9" * (p - d) + ("." + "9" * d if d else "")).cast(f"decimal({p},{d})")
    x = F.round(s.cast("decimal(38,12)"), d)
    return F.when(x > edge, edge).when(x < -edge, -edge).otherwise(x.try_cast(f"decimal({p},{d})"))


def cast_char(x: Column, n: int | None = None) -> Column:
    s = x.cast("string")
    return s if n is None else F.left(s, F.lit(n))


def cast_date(s: Column) -> Column:
    """CAST(s AS DATE): NULL for what isn't a date."""
    return s.cast("string").try_cast("date")


def cast_double(s: Column) -> Column:
    return number(s.cast("string"))


# strings
def substring_index(s: Column, delimiter: str, n: int) -> Column:
    return F.substring_index(s, delimiter, n) if delimiter else F.when(s.isNotNull(), "")


def replace(s: Column, a: Column, b: Column) -> Column:
    """An empty search string leaves s as it is."""
    return F.when(a == "", s).otherwise(F.replace(s, a, b))


def char_(*codes: Column) -> Column:
    """CHAR(n, ...): the bytes of each number, NULLs left out, as binary."""
    hexed = lambda c: F.hex(c.cast("bigint"))
    even = [F.when(c.isNotNull(), F.unhex(F.when(F.length(hexed(c)) % 2 == 1, F.concat(F.lit("0"), hexed(c))).otherwise(hexed(c)))).otherwise(F.lit("").cast("binary")) for c in codes]
    return F.concat(*even)


#: The digit of each letter from A to Z, 0 for those without (fixed values).
_SOUNDS = "01230120022455012623010202"


def soundex(s: Column) -> Column:
    """SOUNDEX of any length, four characters at least: vowels part nothing, letters of one digit in a row count once."""
    letters = F.regexp_replace(F.upper(plain(s)), "[^A-Z]", "")
    code = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _SOUNDS)
    once = F.regexp_replace(F.regexp_replace(code, "0", ""), r"(\d)\1+", "$1")
    first = F.left(code, F.lit(1))
    tail = F.when(first == "0", once).otherwise(F.substring(once, F.lit(2), F.length(once)))
    return F.when(s.isNull(), None).when(letters == "", "").otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), tail), F.greatest(F.lit(4), F.length(tail) + 1), F.lit("0")))


def to_base64(s: Column) -> Column:
    """A line feed after each 76 characters but the last ones."""
    plain_ = F.regexp_replace(F.base64(s.cast("binary")), r"\s", "")
    return F.regexp_replace(plain_, r"(.{76})(?=.)", "$1\n")


def format_(x: Column, d: int) -> Column:
    """FORMAT: grouped thousands, halves away from zero; a negative d counts as 0.

    A DOUBLE is rounded by its exact binary value and keeps the sign of a negative zero.
    """
    exact = F.format_number(F.round(x.cast("decimal(38,12)"), max(d, 0)), max(d, 0))
    return F.when(F.typeof(x).isin("double", "float"), F.format_number(x.cast("double"), max(d, 0))).otherwise(exact)


def weight_string(s: Column) -> Column:
    """Equal for strings that are equal by collation."""
    return F.upper(plain(s)).cast("binary")


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    """REGEXP_LIKE: without regard to case, unless flags have c (of c and i the last counts); m and n as in lines."""
    case = [f for f in flags if f in "ci"]
    inline = ("" if case and case[-1] == "c" else "i") + ("m" if "m" in flags else "") + ("s" if "n" in flags else "")
    return s.rlike(f"(?{inline}){pattern}" if inline else pattern).cast("int")


def regexp_instr(s: Column, pattern: str) -> Column:
    return F.regexp_instr(s, F.lit(f"(?i){pattern}"))


def regexp_substr(s: Column, pattern: str) -> Column:
    return F.regexp_substr(s, F.lit(f"(?i){pattern}"))


def regexp_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, f"(?i){pattern}", new)


# identifiers and addresses
def inet_aton(s: Column) -> Column:
    """The number of an IPv4 address; short forms fill from the right (1.2 is 1.0.0.2); NULL for others."""
    part = F.transform(F.split(s, r"\."), lambda x: x.try_cast("bigint"))
    n = F.size(part)
    head = F.aggregate(F.slice(part, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    lead = head * F.pow(F.lit(256), 5 - n).cast("bigint")
    whole = F.when(n == 1, 0).otherwise(lead) + F.element_at(part, -1)
    return F.when(s.rlike(r"^\d{1,3}(\.\d{1,3}){0,3}$") & F.forall(part, lambda x: x < 256), whole)


def inet_ntoa(n: Column) -> Column:
    n = n.cast("bigint")
    parts = [F.shiftright(n, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)]
    return F.when((n >= 0) & (n < 1 << 32), F.concat_ws(".", *parts))


def is_uuid(s: Column) -> Column:
    return s.rlike(r"(?i)^(\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32})$").cast("int")


def uuid_to_bin(s: Column, swap: bool = False) -> Column:
    """16 bytes; with swap, the parts of the time stand from high to low."""
    h = F.regexp_replace(s, "[-{}]", "")
    cut = lambda a, n: F.substring(h, F.lit(a), F.lit(n))
    h = F.concat(cut(13, 4), cut(9, 4), cut(1, 8), cut(17, 16)) if swap else h
    return F.when(is_uuid(s) == 1, F.unhex(h))


def bin_to_uuid(b: Column, swap: bool = False) -> Column:
    h = F.lower(F.hex(b))
    cut = lambda a, n: F.substring(h, F.lit(a), F.lit(n))
    parts = [cut(9, 8), cut(5, 4), cut(1, 4), cut(17, 4), cut(21, 12)] if swap else [cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)]
    return F.when(F.octet_length(b) == 16, F.concat_ws("-", *parts))


def sha2(s: Column, bits_: int) -> Column:
    """NULL for a length that isn't 0, 224, 256, 384 or 512."""
    return F.sha2(s.cast("binary"), bits_) if bits_ in (0, 224, 256, 384, 512) else F.lit(None).cast("string")


def aes_key(key: bytes, size: int = 16) -> bytes:
    """A key of any length folded to `size` bytes by exclusive or."""
    out = bytearray(size)
    for i, b in enumerate(key):
        out[i % size] ^= b
    return bytes(out)


def aes_encrypt(s: Column, key: bytes) -> Column:
    """AES-128-ECB with padding."""
    return F.aes_encrypt(s.cast("binary"), F.lit(bytearray(aes_key(key))), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(b: Column, key: bytes) -> Column:
    """NULL for what the key doesn't decrypt."""
    return F.try_aes_decrypt(b, F.lit(bytearray(aes_key(key))), F.lit("ECB"), F.lit("PKCS"))


def format_bytes(n: Column) -> Column:
    """FORMAT_BYTES: bytes as such below 1,024, else with two digits and a unit."""
    out = F.when(F.abs(n) < 1024, F.concat(F.lpad(F.format_string("%d", n.cast("bigint")), 4, " "), F.lit(" bytes")))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        # format_number rounds the exact binary value, halves to even, as printf in C; %.2f here would round halves up
        text = F.concat(F.replace(F.format_number(n.cast("double") / F.lit(float(1024**k)), 2), F.lit(",")), F.lit(" " + unit))
        out = out.otherwise(text) if unit == "EiB" else out.when(F.abs(n) < 1024 ** (k + 1), text)
    return out


def equal(a: Column, b: Column) -> Column:
    """String equality under the default collation."""
    return (ci(a) == ci(b)).cast("int")


def decimal_unsigned(c: Column) -> Column:
    return c.cast(UNSIGNED)


def compress(s: Column) -> Column:
    """COMPRESS: four bytes of length, then the deflated bytes; an empty string stays empty."""
    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        import zlib

        pack = lambda b: b and len(b).to_bytes(4, "little") + zlib.compress(b)
        return batch.map(lambda b: None if b is None else pack(bytes(b)))

    return run(s.cast("binary"))


def uncompress(b: Column) -> Column:
    """NULL for what isn't compressed data."""
    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        import zlib

        def one(x):
            if x is None or not len(x):
                return x
            try:
                out = zlib.decompress(bytes(x)[4:])
            except zlib.error:
                return None
            return out if len(out) == int.from_bytes(bytes(x)[:4], "little") else None

        return batch.map(one)

    return run(b)


def uncompressed_length(b: Column) -> Column:
    """The length that compressed data begin with; 0 for an empty string."""
    h = F.hex(F.substring(b, 1, 4))
    turned = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    return F.when(F.octet_length(b) == 0, 0).when(F.octet_length(b) > 4, F.conv(turned, 16, 10).cast("bigint"))
