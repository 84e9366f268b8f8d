"""Registered queries of single functions: for each column, the function beside what DuckDB computes for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions import json as J
from ..functions import scalar as S
from ..functions import temporal as T
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "nation": "n_nationkey"}


def _add(name: str, frame: str, **columns) -> None:
    """columns: name -> (function that makes the Column, DuckDB expression)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, frame).select(KEYS[frame], *(make().alias(c) for c, (make, _) in columns.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {KEYS[frame]}, " + ", ".join(f"{duck} AS {c}" for c, (_, duck) in columns.items()) + f" FROM {frame}"


C = F.col
K = lambda: C("c_custkey")
N = lambda: C("c_name")
B = lambda: C("c_acctbal")
E = lambda: F.concat(C("c_name"), F.lit("é"))
TS = lambda: C("ts").cast("timestamp_ntz")
P = lambda: C("props")
_k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_dec = "CAST(c_acctbal AS DECIMAL(18,2))"

_add("string_lengths", "customer", a=(lambda: F.char_length(E()), "CAST(length(c_name || 'é') AS INT)"), b=(lambda: F.octet_length(E()), "CAST(octet_length(encode(c_name || 'é')) AS INT)"), c=(lambda: F.bit_length(E()), "CAST(8 * octet_length(encode(c_name || 'é')) AS INT)"))
_add("case_functions", "customer", a=(lambda: F.lower(N()), "lower(c_name)"), b=(lambda: F.upper(N()), "upper(c_name)"))
_add("replace_string", "customer", a=(lambda: S.replace(N(), F.lit("0"), F.lit("<>")), "replace(c_name, '0', '<>')"), b=(lambda: S.replace(N(), F.lit(""), F.lit("x")), "c_name"), c=(lambda: S.replace(N(), F.lit("CUST"), F.lit("x")), "c_name"))
_add("substring_index", "customer", a=(lambda: S.substring_index(N(), "#", 1), "split_part(c_name, '#', 1)"), b=(lambda: S.substring_index(N(), "#", -1), "split_part(c_name, '#', -1)"), c=(lambda: S.substring_index(N(), "0", 2), "split_part(c_name, '0', 1) || CASE WHEN length(c_name) - length(replace(c_name, '0', '')) >= 1 THEN '0' || split_part(c_name, '0', 2) ELSE '' END"))
_add("trim_sides", "customer", a=(lambda: F.concat(F.lit("["), F.ltrim(F.concat(F.lit("  "), N(), F.lit("  "))), F.lit("]")), "'[' || c_name || '  ]'"), b=(lambda: F.concat(F.lit("["), F.rtrim(F.concat(F.lit("  "), N(), F.lit("  "))), F.lit("]")), "'[  ' || c_name || ']'"), c=(lambda: D.trim(F.concat(F.lit("xyxy"), N(), F.lit("xyx")), "xy", "leading"), "c_name || 'xyx'"), d=(lambda: D.trim(F.concat(F.lit("xy"), N(), F.lit("xyxy")), "xy", "trailing"), "'xy' || c_name"))
_add("char_function", "customer", a=(lambda: S.char_(K() % 26 + 65, F.lit(None).cast("int"), F.lit(33)).cast("string"), "chr(CAST(65 + c_custkey % 26 AS INT)) || '!'"))
_add("base64_functions", "customer", a=(lambda: S.to_base64(N()), "base64(encode(c_name))"), b=(lambda: D.from_base64(S.to_base64(F.repeat(N(), 8))).cast("string"), "repeat(c_name, 8)"), n=(lambda: F.octet_length(S.to_base64(F.repeat(N(), 8))), "CAST(ceil(octet_length(encode(c_name)) * 8 / 3.0) * 4 + (CAST(ceil(octet_length(encode(c_name)) * 8 / 3.0) * 4 AS INT) - 1) // 76 AS INT)"))
_add("format_num", "customer", a=(lambda: S.format_(B(), 2), "format('{:,.2f}', c_acctbal)"), b=(lambda: S.format_(K() * 1234567, -1), "format('{:,}', c_custkey * 1234567)"))
_add("conv_bases", "customer", a=(lambda: S.conv(K(), 10, 16), "upper(to_hex(c_custkey))"), b=(lambda: S.conv(F.hex(K()), 16, 10), "CAST(c_custkey AS VARCHAR)"), c=(lambda: S.oct_(K()), "format('{:o}', c_custkey)"), d=(lambda: S.conv(K(), 10, 99), "NULL::VARCHAR"), e=(lambda: F.unhex(F.hex(N())).cast("string"), "c_name"))
_add("round_family", "customer", a=(lambda: F.round(B().cast("decimal(18,2)"), 1).cast("double"), f"CAST(round({_dec}, 1) AS DOUBLE)"), b=(lambda: F.round(K(), -2).cast("bigint"), "CAST(sign(c_custkey) * ((abs(c_custkey) + 50) // 100) * 100 AS BIGINT)"), c=(lambda: S.truncate(B(), 1).cast("double"), f"CAST(sign({_dec}) * floor(abs({_dec}) * 10) / 10 AS DOUBLE)"), d=(lambda: S.truncate(K(), -2).cast("bigint"), "CAST(c_custkey // 100 * 100 AS BIGINT)"))
_add("power_log", "customer", a=(lambda: F.pow(K() % 7, F.lit(3)), "CAST(pow(c_custkey % 7, 3) AS DOUBLE)"), b=(lambda: F.round(S.exp(K() % 9), 6), "round(exp(c_custkey % 9), 6)"), c=(lambda: F.round(S.log(F.lit(3), K()), 6), "CASE WHEN c_custkey > 0 THEN round(ln(c_custkey) / ln(3), 6) END"), d=(lambda: F.round(S.log2(K()), 6), "CASE WHEN c_custkey > 0 THEN round(log2(c_custkey), 6) END"), e=(lambda: F.round(S.log10(B()), 6), "CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END"), f=(lambda: F.round(S.ln(B()), 6), "CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END"), g=(lambda: S.log(F.lit(1), K()), "NULL::DOUBLE"))
_add("trigonometry", "customer", a=(lambda: F.round(F.cos(K()), 6), "round(cos(c_custkey), 6)"), b=(lambda: F.round(F.tan(K()), 4), "round(tan(c_custkey), 4)"), c=(lambda: F.round(S.cot(K() + 1), 4), "round(1 / tan(c_custkey + 1), 4)"), d=(lambda: F.round(S.acos(K() % 4 - 1), 6), "CASE WHEN c_custkey % 4 < 3 THEN round(acos(least(c_custkey % 4 - 1, 1)), 6) END"), e=(lambda: F.round(S.asin(K() % 4 - 1), 6), "CASE WHEN c_custkey % 4 < 3 THEN round(asin(least(c_custkey % 4 - 1, 1)), 6) END"), f=(lambda: F.round(F.atan(K()), 6), "round(atan(c_custkey), 6)"), g=(lambda: F.round(F.atan2(K(), F.lit(3)), 6), "round(atan2(c_custkey, 3), 6)"), h=(lambda: F.round(F.degrees(K().cast("double")), 4), "round(degrees(c_custkey), 4)"), i=(lambda: F.round(F.radians(K().cast("double")), 6), "round(radians(c_custkey), 6)"), p=(lambda: F.round(F.pi(), 6), "round(pi(), 6)"))
_add("unary_sign", "customer", a=(lambda: -K(), "-c_custkey"), b=(lambda: F.abs(B()), "abs(c_acctbal)"), c=(lambda: F.signum(K() - 50).cast("int"), "CAST(sign(c_custkey - 50) AS INT)"))
_add("bit_count", "customer", a=(lambda: S.bit_count(K()), "CAST(bit_count(c_custkey) AS INT)"), b=(lambda: S.bit_count(D.bit_not(K())), "CAST(64 - bit_count(c_custkey) AS INT)"))
_add("interval_function", "customer", a=(lambda: S.interval(K() % 10, F.lit(2), F.lit(5), F.lit(8)), "CAST(CASE WHEN c_custkey % 10 < 2 THEN 0 WHEN c_custkey % 10 < 5 THEN 1 WHEN c_custkey % 10 < 8 THEN 2 ELSE 3 END AS INT)"), b=(lambda: S.interval(F.nullif(K() % 10, F.lit(3)), F.lit(2)), "CAST(CASE WHEN c_custkey % 10 = 3 THEN -1 WHEN c_custkey % 10 < 2 THEN 0 ELSE 1 END AS INT)"))
_add("if_functions", "customer", a=(lambda: S.if_(F.nullif(K() % 3, F.lit(2)) == 1, F.lit("one"), F.lit("other")), "CASE WHEN c_custkey % 3 = 1 THEN 'one' ELSE 'other' END"), b=(lambda: S.ifnull(F.nullif(K() % 3, F.lit(2)), F.lit(-1)).cast("bigint"), "CAST(CASE WHEN c_custkey % 3 = 2 THEN -1 ELSE c_custkey % 3 END AS BIGINT)"), c=(lambda: S.is_null(F.nullif(K() % 3, F.lit(2))), "CAST(c_custkey % 3 = 2 AS INT)"), d=(lambda: S.is_true(F.nullif(K() % 3, F.lit(2))), "CAST(c_custkey % 3 = 1 AS INT)"), e=(lambda: F.nullif(K() % 3, F.lit(2)).cast("bigint"), "CAST(nullif(c_custkey % 3, 2) AS BIGINT)"))
_add("cast_family", "customer",
    a=(lambda: S.cast_signed(F.concat(F.lit(" -"), K().cast("string"), F.lit("9.7abc"))), "-CAST(CAST(c_custkey AS VARCHAR) || '9' AS BIGINT)"), b=(lambda: S.cast_unsigned(-K()).cast("string"), "CASE WHEN c_custkey = 0 THEN '0' ELSE CAST(18446744073709551616::HUGEINT - c_custkey AS VARCHAR) END"),
    c=(lambda: S.cast_decimal(B(), 5, 1).cast("double"), f"CAST(greatest(least(round({_dec}, 1), 9999.9), -9999.9) AS DOUBLE)"), d=(lambda: S.cast_char(N(), 3), "left(c_name, 3)"), e=(lambda: S.cast_date(F.concat(F.lit("1995-01-"), F.lpad((K() % 40).cast("string"), 2, "0"))), "TRY_CAST('1995-01-' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') AS DATE)"),
    f=(lambda: S.cast_double(F.concat(K().cast("string"), F.lit(".25e1kg"))), "CAST(CAST(c_custkey AS VARCHAR) || '.25e1' AS DOUBLE)"), g=(lambda: S.cast_signed(F.repeat(F.lit("9"), 30)), "9223372036854775807"))
_add("division_exact", "customer", a=(lambda: D.divide(B().cast("decimal(12,2)"), F.lit(2.5), 6).cast("double"), f"CAST(round({_dec} / CAST(2.5 AS DECIMAL(3,1)), 6) AS DOUBLE)"), b=(lambda: D.divide(F.lit(1), F.lit(2.5) + (K() - K())).cast("double"), "0.4::DOUBLE"), c=(lambda: D.divide(K(), K() - K()).cast("double"), "NULL::DOUBLE"))
_add("field_collation", "customer", a=(lambda: D.field(C("c_mktsegment"), F.lit("building"), F.lit("Machinery")), "CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS INT)"), b=(lambda: D.find_in_set(C("c_mktsegment"), F.lit("furniture,building")), "CAST(CASE c_mktsegment WHEN 'FURNITURE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS INT)"), c=(lambda: D.locate(F.lit("OMER"), N()), "CAST(strpos(lower(c_name), 'omer') AS INT)"), d=(lambda: D.locate(F.lit("0"), N(), 12), "CAST(CASE WHEN strpos(substr(c_name, 12), '0') > 0 THEN strpos(substr(c_name, 12), '0') + 11 ELSE 0 END AS INT)"))
_add("export_set_null", "customer", a=(lambda: D.export_set(F.nullif(K() % 3, F.lit(2)), "Y", "N", ",", 3), "CASE c_custkey % 3 WHEN 0 THEN 'N,N,N' WHEN 1 THEN 'Y,N,N' END"), b=(lambda: F.length(D.export_set(K(), "1", "0", "", -1)), "64"))
_add("shifts_unsigned", "customer", a=(lambda: D.shift_left(D.bit_not(K()), F.lit(4)).cast("string"), "CAST((18446744073709551615 - c_custkey::HUGEINT) * 16 % 18446744073709551616 AS VARCHAR)"), b=(lambda: D.shift_right(D.bit_not(K()), F.lit(60)).cast("string"), "'15'"))
_add("like_escape", "customer", a=(lambda: D.truth(D.like(F.concat(N(), F.lit("%é")), "customer#%|%e", "|")), "1"), b=(lambda: D.truth(D.like(N(), "%|%%", "|")), "0"))
_add("collate_cmp", "customer", a=(lambda: S.equal(C("c_mktsegment"), F.lit("building")), "CAST(lower(c_mktsegment) = 'building' AS INT)"), b=(lambda: (F.collate(C("c_mktsegment"), "UTF8_BINARY") == "building").cast("int"), "0"), c=(lambda: S.equal(F.lit("Résumé"), F.concat(F.lit("RESUME"), F.repeat(F.lit(" "), (K() % 1).cast("int")))), "1"))
_add("regexp_flags", "customer", a=(lambda: S.regexp_like(N(), "^CUST", "c"), "0"), b=(lambda: S.regexp_like(N(), "^CUST"), "1"), c=(lambda: S.regexp_instr(N(), "[1-9]"), "CAST(coalesce(length(regexp_extract(c_name, '^[^1-9]*')) + 1, 0) * CAST(regexp_matches(c_name, '[1-9]') AS INT) AS INT)"), d=(lambda: S.regexp_substr(N(), "OMER#0+"), "regexp_extract(c_name, 'omer#0+')"), e=(lambda: S.regexp_replace(N(), "CUSTOMER", "c"), "replace(c_name, 'Customer', 'c')"))
_uuid = "(substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21))"
U = lambda: F.regexp_replace(F.md5(N()), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
_add("uuid_functions", "customer", a=(lambda: S.bin_to_uuid(S.uuid_to_bin(U(), True), True), _uuid), b=(lambda: F.lower(F.hex(S.uuid_to_bin(U(), True))), "substr(md5(c_name), 13, 4) || substr(md5(c_name), 9, 4) || substr(md5(c_name), 1, 8) || substr(md5(c_name), 17)"), c=(lambda: S.is_uuid(U()), "1"), d=(lambda: S.is_uuid(N()), "0"), e=(lambda: S.bin_to_uuid(S.uuid_to_bin(N())), "NULL::VARCHAR"))
_add("inet_functions", "customer", a=(lambda: S.inet_ntoa(K() * 65793), "concat_ws('.', (c_custkey * 65793) >> 24 & 255, (c_custkey * 65793) >> 16 & 255, (c_custkey * 65793) >> 8 & 255, (c_custkey * 65793) & 255)"), b=(lambda: S.inet_aton(S.inet_ntoa(K() * 65793)), "c_custkey * 65793"), c=(lambda: S.inet_aton(N()), "NULL::BIGINT"), d=(lambda: S.inet_aton(F.concat(F.lit("10."), (K() % 256).cast("string"))), "10 * 16777216 + c_custkey % 256"))
_add("aes_functions", "customer", a=(lambda: S.aes_decrypt(S.aes_encrypt(N(), b"a key that is longer than sixteen"), b"a key that is longer than sixteen").cast("string"), "c_name"), b=(lambda: F.octet_length(S.aes_encrypt(N(), b"k")), "CAST(octet_length(encode(c_name)) // 16 * 16 + 16 AS INT)"))
_add("compress_functions", "customer", a=(lambda: S.uncompress(S.compress(F.repeat(N(), 50))).cast("string"), "repeat(c_name, 50)"), b=(lambda: S.uncompressed_length(S.compress(F.repeat(N(), 50))), "CAST(50 * octet_length(encode(c_name)) AS BIGINT)"), c=(lambda: S.uncompress(N().cast("binary")).cast("string"), "NULL::VARCHAR"))
_add("digest_lengths", "customer", a=(lambda: S.sha2(N(), 0), "sha256(c_name)"), b=(lambda: S.sha2(N(), 111), "NULL::VARCHAR"), c=(lambda: F.length(S.sha2(N(), 512)), "128"))
_add("format_bytes", "customer", a=(lambda: S.format_bytes(K() * 1048576), "CASE WHEN c_custkey = 0 THEN '   0 bytes' WHEN c_custkey < 1024 THEN printf('%.2f MiB', CAST(c_custkey AS DOUBLE)) ELSE printf('%.2f GiB', c_custkey / 1024.0) END"))

# time
_add("time_parts", "events", h=(lambda: F.hour(TS()), "CAST(hour(ts) AS INT)"), m=(lambda: F.minute(TS()), "CAST(minute(ts) AS INT)"), s=(lambda: F.second(TS()), "CAST(second(ts) AS INT)"), u=(lambda: T.microsecond(TS()), "CAST(microsecond(ts) % 1000000 AS BIGINT)"))
_add("extract_composite", "events", a=(lambda: T.extract("YEAR_MONTH", TS()), "CAST(strftime(ts, '%Y%m') AS BIGINT)"), b=(lambda: T.extract("DAY_MINUTE", TS()), "CAST(strftime(ts, '%d%H%M') AS BIGINT)"), c=(lambda: T.extract("HOUR_SECOND", TS()), "CAST(strftime(ts, '%H%M%S') AS BIGINT)"), d=(lambda: T.extract("DAY_MICROSECOND", TS()), "CAST(strftime(ts, '%d%H%M%S%f') AS BIGINT)"), e=(lambda: T.extract("SECOND_MICROSECOND", TS()), "CAST(strftime(ts, '%S%f') AS BIGINT)"), f=(lambda: T.extract("WEEK", TS()), "CAST(strftime(ts, '%U') AS BIGINT)"))
_add("timestampadd", "events", a=(lambda: T.timestampadd("MONTH", C("event_id") % 30, TS()), "ts + to_months(CAST(event_id % 30 AS INT))"), b=(lambda: T.timestampadd("MICROSECOND", C("event_id"), TS()), "ts + to_microseconds(event_id)"), c=(lambda: T.timestampadd("WEEK", F.lit(-2), TS()), "ts - INTERVAL 14 DAY"), d=(lambda: T.timestampadd("QUARTER", F.lit(1), TS()), "ts + INTERVAL 3 MONTH"))
_then = "TIMESTAMP '2023-12-15 13:30:00'"
THEN = lambda: F.lit("2023-12-15 13:30:00").cast("timestamp_ntz")
_add("timestampdiff", "events", a=(lambda: T.timestampdiff("MONTH", THEN(), TS()), f"CAST(date_sub('month', {_then}, ts) AS BIGINT)"), b=(lambda: T.timestampdiff("DAY", THEN(), TS()), f"CAST(date_sub('day', {_then}, ts) AS BIGINT)"), c=(lambda: T.timestampdiff("HOUR", TS(), THEN()), f"CAST(date_sub('hour', ts, {_then}) AS BIGINT)"), d=(lambda: T.timestampdiff("MICROSECOND", THEN(), TS()), f"CAST(date_sub('microsecond', {_then}, ts) AS BIGINT)"), e=(lambda: T.timestampdiff("YEAR", THEN(), TS()), f"CAST(date_sub('year', {_then}, ts) AS BIGINT)"))
_add("time_arithmetic", "events", a=(lambda: T.time_text(T.timediff(TS(), F.date_trunc("day", TS()).cast("timestamp_ntz"))), "strftime(ts, '%H:%M:%S')"), b=(lambda: T.addtime(TS(), T.time_of(F.lit("26:01:02.5"))), "ts + INTERVAL '93662.5 seconds'"), c=(lambda: T.time_text(T.timediff(TS(), F.lit("1990-01-01").cast("timestamp_ntz"))), "'838:59:59'"), d=(lambda: T.time_text(T.time_of(TS()), 6), "strftime(ts, '%H:%M:%S.%f')"), e=(lambda: T.time_to_sec(T.time_of(TS())), "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"), f=(lambda: T.time_text(T.sec_to_time(C("event_id"))), "lpad(CAST(event_id // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')"))
_add("make_dates", "events", a=(lambda: T.makedate(F.lit(2024), C("event_id") % 800), "CASE WHEN event_id % 800 > 0 THEN CAST(DATE '2024-01-01' + CAST(event_id % 800 - 1 AS INT) AS DATE) END"), b=(lambda: T.time_text(T.maketime(C("event_id") % 100, F.lit(5), C("event_id") % 70)), "CASE WHEN event_id % 70 < 60 THEN lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || ':05:' || lpad(CAST(event_id % 70 AS VARCHAR), 2, '0') END"))
_add("str_to_date", "events", a=(lambda: T.str_to_date(F.date_format(TS(), "dd/MM/yyyy HH:mm"), "%d/%m/%Y %H:%i"), "date_trunc('minute', ts)"), b=(lambda: T.str_to_date(F.date_format(TS(), "MMMM d, yyyy"), "%M %e, %Y").cast("date"), "CAST(ts AS DATE)"), c=(lambda: T.str_to_date(F.concat(F.lit("31/"), F.date_format(TS(), "MM/yyyy")), "%d/%m/%Y").cast("date"), "TRY_CAST(strftime(ts, '%Y-%m-') || '31' AS DATE)"), d=(lambda: T.str_to_date(C("event_type"), "%Y"), "NULL::TIMESTAMP"), e=(lambda: T.str_to_date(F.date_format(TS(), "yy h:mm a"), "%y %h:%i %p"), "date_trunc('year', ts) + to_minutes(hour(ts) * 60 + minute(ts))"))
_add("unix_time", "events", a=(lambda: T.unix_timestamp(TS()), "CAST(floor(epoch(ts)) AS BIGINT)"), b=(lambda: T.from_unixtime(T.unix_timestamp(TS())), "date_trunc('second', ts)"), c=(lambda: T.from_unixtime(F.lit(-1)), "NULL::TIMESTAMP"), d=(lambda: T.to_seconds(TS()), "CAST(floor(epoch(ts)) AS BIGINT) + 62167219200"))
_add("convert_tz", "events", a=(lambda: T.convert_tz(TS(), "+00:00", "+05:30"), "ts + INTERVAL 330 MINUTE"), b=(lambda: T.convert_tz(T.convert_tz(TS(), "UTC", "America/New_York"), "America/New_York", "UTC"), "ts"))
_add("get_format", "events", a=(lambda: D.date_format(TS(), T.get_format("datetime", "eur")), "strftime(ts, '%Y-%m-%d %H.%M.%S')"), b=(lambda: D.date_format(TS(), T.get_format("DATE", "USA")), "strftime(ts, '%m.%d.%Y')"))
_add("timestamp_text", "events", a=(lambda: T.timestamp(F.concat(F.lit("2024-02-"), F.lpad((C("event_id") % 40).cast("string"), 2, "0"), F.lit(" 10:11:12"))), "TRY_CAST('2024-02-' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') || ' 10:11:12' AS TIMESTAMP)"), b=(lambda: F.to_date(TS()), "CAST(ts AS DATE)"), c=(lambda: F.dayofmonth(TS()), "CAST(day(ts) AS INT)"), d=(lambda: F.month(TS()), "CAST(month(ts) AS INT)"))

# JSON
_add("json_extract", "events", a=(lambda: J.json_extract(P(), "$.k"), f"CAST({_k} AS VARCHAR)"), b=(lambda: J.json_extract(P(), "$.none"), "NULL::VARCHAR"), c=(lambda: J.json_extract(P(), "$.k", "$.k"), f"'[' || {_k} || ', ' || {_k} || ']'"), d=(lambda: J.json_extract(P(), "$.*"), f"'[' || {_k} || ']'"), e=(lambda: J.json_extract(P(), "$.k[0]"), f"CAST({_k} AS VARCHAR)"))
_add("json_value", "events", a=(lambda: J.json_value(P(), "$.k").cast("bigint"), _k), b=(lambda: J.json_unquote(J.json_quote(C("event_type"))), "event_type"), c=(lambda: J.json_quote(C("event_type")), "'\"' || event_type || '\"'"))
_add("json_keys_len", "events", a=(lambda: J.json_keys(P()), "'[\"k\"]'"), b=(lambda: J.json_length(P()), "CAST(len(json_keys(props)) AS INT)"), c=(lambda: J.json_length(P(), "$.k"), "1"), d=(lambda: J.json_depth(P()), "2"), e=(lambda: J.json_type(P()), "json_type(props)"), f=(lambda: J.json_valid(C("event_type")), "CAST(json_valid(event_type) AS INT)"), g=(lambda: J.json_valid(P()), "CAST(json_valid(props) AS INT)"), h=(lambda: J.json_storage_size(P()), "CAST(octet_length(encode(props)) AS INT)"))
_add("json_contains", "events", a=(lambda: J.json_contains(P(), '{"k": 7}'), f"CAST({_k} = 7 AS INT)"), b=(lambda: J.json_contains(P(), "7", "$.k"), f"CAST({_k} = 7 AS INT)"), c=(lambda: J.json_contains(P(), "7", "$.x"), "NULL::INT"), d=(lambda: J.json_contains_path(P(), False, "$.x", "$.k"), "1"), e=(lambda: J.json_contains_path(P(), True, "$.x", "$.k"), "0"), f=(lambda: J.json_overlaps(P(), '{"k": 7, "z": 1}'), f"CAST({_k} = 7 AS INT)"), g=(lambda: J.member_of(C("event_id") % 5, F.lit("[1, 3]")), "CAST(event_id % 5 IN (1, 3) AS INT)"))
_add("json_mutate", "events", a=(lambda: J.json_set(P(), "$.k", 1, "$.new", "x"), "'{\"k\": 1, \"new\": \"x\"}'"), b=(lambda: J.json_insert(P(), "$.k", 1, "$.a", C("event_type")), f"'{{\"a\": \"' || event_type || '\", \"k\": ' || {_k} || '}}'"), c=(lambda: J.json_replace(P(), "$.k", None, "$.a", 2), "'{\"k\": null}'"), d=(lambda: J.json_remove(P(), "$.k"), "'{}'"), e=(lambda: J.json_array_append(P(), "$.k", 5), f"'{{\"k\": [' || {_k} || ', 5]}}'"), f=(lambda: J.json_array_insert(F.lit("[1, 2]"), "$[1]", J.document(P())), f"'[1, {{\"k\": ' || {_k} || '}}, 2]'"), g=(lambda: J.json_set(P(), "$.k[1]", True), f"'{{\"k\": [' || {_k} || ', true]}}'"))
_add("json_merge", "events", a=(lambda: J.json_merge_preserve(P(), '{"k": 1, "a": null}'), f"'{{\"a\": null, \"k\": [' || {_k} || ', 1]}}'"), b=(lambda: J.json_merge_patch(P(), '{"k": null, "a": {"b": 1}}'), "'{\"a\": {\"b\": 1}}'"))
_add("json_search", "events", a=(lambda: J.json_search(J.json_set(P(), "$.t", C("event_type")), False, "p%"), "CASE WHEN event_type LIKE 'p%' THEN '\"$.t\"' END"), b=(lambda: J.json_search(F.lit('["ab", {"x": "ac"}]'), True, "a_"), "'[\"$[0]\", \"$[1].x\"]'"), c=(lambda: J.json_schema_valid('{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}}', P()), f"CAST({_k} <= 50 AS INT)"), d=(lambda: J.json_pretty(P()), f"'{{' || chr(10) || '  \"k\": ' || {_k} || chr(10) || '}}'"))
_add("json_build", "events", a=(lambda: J.json_array(C("event_id"), C("event_type"), F.lit(None).cast("string")), "'[' || event_id || ', \"' || event_type || '\", null]'"), b=(lambda: J.json_object(type=C("event_type"), id=C("event_id")), "'{\"id\": ' || event_id || ', \"type\": \"' || event_type || '\"}'"))
