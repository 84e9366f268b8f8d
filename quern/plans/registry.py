"""Registered queries: relational ones as SQL that both engines run, functions as Columns beside plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import dialect as D
from ..operators import dml
from ..operators.quantified import compare_quantified
from ..sources.tables import table, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, spark_sql)
        return spark.sql(spark_sql)

    QUERIES[name] = run
    ORACLE_SQL[name] = duck_sql or spark_sql


def _query(duck_sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = duck_sql
        return f

    return add


_BIG = "CAST({} AS BIGINT)"
_rev = "CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE)"

for _name, _text in {
    "flagship": f"SELECT c_mktsegment, count(*) AS n, {_rev} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 10",
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05 AND l_returnflag <> 'N'",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 100000",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_chain3": "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_anti_notexists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "not_in_null_aware": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey < 0 THEN NULL ELSE o_custkey END FROM orders)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_count": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "derived_join": "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey",
    "groupby_one": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "groupby_multi": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "groupby_expr": "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "having_agg": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "rollup_grouping": "SELECT l_returnflag, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "count_distinct": "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT lower(o_orderstatus)) AS s FROM orders",
    "count_variants": "SELECT count(*) AS a, count(c_custkey) AS b, count(NULL) AS c, count(1 = 1) AS d FROM customer",
    "min_max": "SELECT c_mktsegment, min(c_name) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS INT) AS rn FROM orders",
    "win_rank_family": "SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, percent_rank() OVER w AS p, cume_dist() OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity NULLS FIRST)",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey NULLS FIRST) AS INT) AS t FROM customer",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey, 1, 0) OVER w AS p, lead(o_orderkey, 2) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "win_range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM lineitem",
    "win_named": "SELECT c_custkey, count(*) OVER w AS n, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment)",
    "order_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 50",
    "order_multi": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC NULLS LAST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST LIMIT 100",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey NULLS FIRST LIMIT 10 OFFSET 20",
    "topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_op": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10",
    "except_op": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "values_stmt": "SELECT column_0, column_1 FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(column_0, column_1)",
    "between_in": "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 500 AND o_orderstatus IN ('F', 'O') AND o_custkey NOT IN (1, 2, 3)",
    "row_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F'))",
    "null_safe_eq": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT DISTINCT FROM NULL",
    "is_bool": "SELECT c_custkey, CAST((c_acctbal > 0) IS TRUE AS INT) AS t, CAST((c_acctbal > 0) IS NOT FALSE AS INT) AS f FROM customer",
    "case_if": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS k, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders",
    "concat_family": "SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b FROM customer",
    "win_agg": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS a, min(o_orderkey) OVER (PARTITION BY o_custkey) AS lo FROM orders",
}.items():
    _sql(_name, _text)


def _of(name: str, duck: str, frame: str, **columns) -> None:
    """A query that adds columns to a table's key; columns are functions, so that no session is needed at import."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id"}[frame]
        return table(spark, sf_dir, frame).select(key, *(f().alias(k) for k, f in columns.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = duck


C = F.col
_name = lambda: C("c_name")
_key = lambda: C("c_custkey")
_date = lambda: C("o_orderdate").cast("date")

_of("arith_div_mod", "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round(CAST(o_orderkey AS DOUBLE) / (o_custkey % 7), 4) END AS DOUBLE) AS q, CAST(o_orderkey // nullif(o_custkey % 7, 0) AS BIGINT) AS d, CAST(o_orderkey % nullif(o_custkey % 7, 0) AS BIGINT) AS m FROM orders", "orders",
    q=lambda: D.divide(C("o_orderkey"), C("o_custkey") % 7).cast("double"), d=lambda: D.int_div(C("o_orderkey"), C("o_custkey") % 7).cast("bigint"), m=lambda: D.mod(C("o_orderkey"), C("o_custkey") % 7).cast("bigint"))
_of("bitwise_ops", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 12 AS b, xor(c_custkey, 12) AS x, CAST(18446744073709551615 - CAST(c_custkey AS HUGEINT) AS VARCHAR) AS n, CAST(CAST(c_custkey AS HUGEINT) * 1024 AS VARCHAR) AS l, CAST(c_custkey >> 2 AS VARCHAR) AS r, '0' AS z FROM customer", "customer",
    a=lambda: _key().bitwiseAND(12), b=lambda: _key().bitwiseOR(12), x=lambda: _key().bitwiseXOR(12), n=lambda: D.bit_not(_key()).cast("string"), l=lambda: D.shift_left(_key(), F.lit(10)).cast("string"), r=lambda: D.shift_right(_key(), F.lit(2)).cast("string"), z=lambda: D.shift_left(_key(), F.lit(64)).cast("string"))
_of("xor_logic", "SELECT c_custkey, CAST((c_custkey % 2 <> 0) <> (c_nationkey % 3 <> 0) AS INT) AS x FROM customer", "customer", x=lambda: D.xor(_key() % 2, C("c_nationkey") % 3))
_of("like_ci", "SELECT c_custkey, CAST(c_name ILIKE '%CUSTOMER%1' AS INT) AS a, CAST(c_name LIKE '%CUSTOMER%1' AS INT) AS b FROM customer", "customer", a=lambda: D.truth(D.like(_name(), "%CUSTOMER%1")), b=lambda: D.truth(_name().like("%CUSTOMER%1")))
_of("regexp_family", "SELECT c_custkey, CAST(regexp_matches(c_name, '(?i)CUST.*[13579]$') AS INT) AS a, regexp_replace(c_name, '0+', '_', 'g') AS b, regexp_extract(c_name, '[1-9][0-9]*') AS c FROM customer", "customer", a=lambda: D.truth(D.regexp(_name(), "CUST.*[13579]$")), b=lambda: F.regexp_replace(_name(), "0+", "_"), c=lambda: F.regexp_extract(_name(), "[1-9][0-9]*", 0))
_of("greatest_least", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE greatest(c_custkey, 40) END AS g, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE least(c_custkey, 40) END AS l FROM customer", "customer", g=lambda: D.greatest(_key(), F.when(_key() % 5 != 0, F.lit(40).cast("bigint"))), l=lambda: D.least(_key(), F.when(_key() % 5 != 0, F.lit(40).cast("bigint"))))
_of("substring_family", "SELECT c_custkey, '' AS z, substr(c_name, 3, 4) AS a, right(c_name, 3) AS b, left(c_name, 2) AS c, '' AS far FROM customer", "customer", z=lambda: D.substring(_name(), F.lit(0), F.lit(3)), a=lambda: D.substring(_name(), F.lit(3), F.lit(4)), b=lambda: D.substring(_name(), F.lit(-3)), c=lambda: F.left(_name(), F.lit(2)), far=lambda: D.substring(_name(), F.lit(-99), F.lit(5)))
_of("pad_repeat", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '*') AS l, rpad(CAST(c_custkey AS VARCHAR), 2, '-') AS r, NULL::VARCHAR AS n, '' AS e, repeat('ab', CAST(c_custkey % 4 AS BIGINT)) AS p FROM customer", "customer",
    l=lambda: D.pad(_key().cast("string"), F.lit(9), F.lit("*"), True), r=lambda: D.pad(_key().cast("string"), F.lit(2), F.lit("-"), False), n=lambda: D.pad(_name(), F.lit(-1), F.lit("x"), True), e=lambda: D.pad(_name(), F.lit(500), F.lit(""), True), p=lambda: F.repeat(F.lit("ab"), (_key() % 4).cast("int")))
_of("trim_family", "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Cu') THEN substr(c_name, 3) ELSE c_name END AS a, trim('  ' || c_name || ' ') AS b FROM customer", "customer", a=lambda: D.trim(_name(), "Cu", "leading"), b=lambda: F.trim(F.concat(F.lit("  "), _name(), F.lit(" "))))
_of("hex_conv", "SELECT c_custkey, upper(to_hex(c_custkey)) AS h, bin(c_custkey) AS b, octet_length(encode(c_name)) AS n FROM customer", "customer", h=lambda: F.hex(_key()), b=lambda: F.bin(_key()), n=lambda: F.octet_length(_name()).cast("bigint"))
_of("elt_field", "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS BIGINT) AS f FROM customer", "customer", e=lambda: D.elt(_key() % 4, F.lit("a"), F.lit("b")), f=lambda: D.field(C("c_mktsegment"), F.lit("BUILDING"), F.lit("MACHINERY")).cast("bigint"))
_of("find_in_set", "SELECT c_custkey, CAST(coalesce(list_position(['BUILDING', 'HOUSEHOLD'], c_mktsegment), 0) AS INT) AS p FROM customer", "customer", p=lambda: F.find_in_set(C("c_mktsegment"), F.lit("BUILDING,HOUSEHOLD")))
_of("make_export_set", "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey & 1 <> 0 THEN 'a' END, CASE WHEN c_custkey & 2 <> 0 THEN 'b' END) AS m, concat_ws('', CASE WHEN c_custkey & 1 <> 0 THEN 'Y' ELSE 'N' END, CASE WHEN c_custkey & 2 <> 0 THEN 'Y' ELSE 'N' END, CASE WHEN c_custkey & 4 <> 0 THEN 'Y' ELSE 'N' END) AS e FROM customer", "customer", m=lambda: D.make_set(_key(), F.lit("a"), F.lit("b")), e=lambda: D.export_set(_key(), "Y", "N", "", 3))
_of("locate_family", "SELECT c_custkey, CAST(strpos(c_name, '0') AS INT) AS i, CAST(strpos(lower(c_name), 'omer') AS INT) AS l FROM customer", "customer", i=lambda: F.instr(_name(), "0"), l=lambda: F.locate("omer", F.lower(_name())))
_of("insert_reverse_quote", "SELECT c_custkey, left(c_name, 1) || 'XY' || substr(c_name, 4) AS i, reverse(c_name) AS r, '''' || c_name || '''' AS q, ascii(c_name) AS o FROM customer", "customer", i=lambda: D.insert(_name(), F.lit(2), F.lit(2), F.lit("XY")), r=lambda: F.reverse(_name()), q=lambda: D.quote(_name()), o=lambda: D.ord_(_name()).cast("int"))
_of("round_truncate", "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS INT) AS s, abs(c_acctbal) AS a FROM customer", "customer", c=lambda: F.ceil("c_acctbal"), f=lambda: F.floor("c_acctbal"), s=lambda: F.signum("c_acctbal").cast("int"), a=lambda: F.abs("c_acctbal"))
_of("trig_log", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS q, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, round(sin(c_acctbal), 6) AS s FROM customer", "customer", q=lambda: F.round(D.guarded(F.sqrt, C("c_acctbal"), C("c_acctbal") >= 0), 6), l=lambda: F.round(D.guarded(F.log, C("c_acctbal"), C("c_acctbal") > 0), 6), s=lambda: F.round(F.sin("c_acctbal"), 6))
_of("crc_digest", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS h FROM customer", "customer", m=lambda: F.md5(_name()), s=lambda: F.sha2(_name(), 256), h=lambda: F.sha1(_name()))
_of("coerce_prefix", "SELECT c_custkey, CAST(coalesce(nullif(regexp_extract(CAST(c_custkey AS VARCHAR) || 'abc', '^\\s*[+-]?\\d+'), ''), '0') AS BIGINT) AS n, CAST(0 AS BIGINT) AS z FROM customer".replace("\\\\", "\\"), "customer", n=lambda: D.number(F.concat(_key().cast("string"), F.lit("abc"))).cast("bigint"), z=lambda: D.number(_name()).cast("bigint"))
_of("strcmp_collate", "SELECT c_custkey, CAST(CASE WHEN lower(c_mktsegment) = 'building' THEN 0 WHEN lower(c_mktsegment) < 'building' THEN -1 ELSE 1 END AS INT) AS s FROM customer", "customer", s=lambda: D.strcmp(C("c_mktsegment"), F.lit("building")))
_of("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) + 1 AS INT) AS w, CAST(isodow(o_orderdate) - 1 AS INT) AS k, last_day(CAST(o_orderdate AS DATE)) AS l, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn FROM orders", "orders",
    y=lambda: F.year(_date()), q=lambda: F.quarter(_date()), d=lambda: F.dayofyear(_date()), w=lambda: F.dayofweek(_date()), k=lambda: F.weekday(_date()), l=lambda: F.last_day(_date()), dn=lambda: D.day_name(_date()), mn=lambda: D.month_name(_date()))
_of("date_arith", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS d, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS n FROM orders", "orders", m=lambda: F.add_months(_date(), 1), d=lambda: F.date_sub(_date(), 10), n=lambda: F.datediff(_date(), F.lit("1995-01-01").cast("date")))
_of("date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %A') AS f FROM orders", "orders", f=lambda: D.date_format(C("o_orderdate"), "%Y/%m/%d %H:%i:%s %W"))
_of("week_modes", "SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS INT) AS w3, CAST(yearweek(o_orderdate) AS INT) AS yw3, CAST(strftime(o_orderdate, '%U') AS INT) AS w0, CAST(strftime(o_orderdate, '%W') AS INT) AS w5 FROM orders", "orders", w3=lambda: D.week(_date(), 3), yw3=lambda: D.yearweek(_date(), 3), w0=lambda: D.week(_date(), 0), w5=lambda: D.week(_date(), 5))
_of("to_days", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INT) AS n, CAST(o_orderdate AS DATE) AS d FROM orders", "orders", n=lambda: D.to_days(_date()), d=lambda: D.from_days(D.to_days(_date())))
_of("period", "SELECT o_orderkey, CAST(strftime(CAST(o_orderdate AS DATE) + INTERVAL 5 MONTH, '%Y%m') AS BIGINT) AS a, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 AS BIGINT) AS d FROM orders", "orders", a=lambda: D.period_add((F.year(_date()) * 100 + F.month(_date())).cast("bigint"), F.lit(5)), d=lambda: D.period_diff((F.year(_date()) * 100 + F.month(_date())).cast("bigint"), F.lit(199001).cast("bigint")))


@_query("SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s, round(CAST(sum(o_custkey) AS DOUBLE) / count(*), 3) AS a, CAST(round(stddev_pop(o_totalprice), 3) AS DOUBLE) AS sd, CAST(round(var_pop(o_custkey), 2) AS DOUBLE) AS v FROM orders GROUP BY o_orderstatus")
def sum_avg_stats(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_orderstatus")
    return out.agg(A.sum_exact(C("o_custkey")).cast("bigint").alias("s"), F.round(A.avg_exact(C("o_custkey")).cast("double"), 3).alias("a"), F.round(A.std(C("o_totalprice")), 3).alias("sd"), F.round(A.variance(C("o_custkey")), 2).alias("v"))


@_query("SELECT o_orderstatus, CAST(bit_and(o_custkey) AS VARCHAR) AS a, CAST(bit_or(o_custkey) AS VARCHAR) AS o, CAST(bit_xor(o_custkey) AS VARCHAR) AS x, '18446744073709551615' AS e FROM orders GROUP BY o_orderstatus")
def bit_aggs(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_orderstatus")
    return out.agg(*(f(C("o_custkey")).cast("string").alias(k) for k, f in (("a", A.bit_and), ("o", A.bit_or), ("x", A.bit_xor))), A.bit_and(F.lit(None)).cast("string").alias("e"))


@_query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS g FROM nation GROUP BY n_regionkey")
def group_concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.group_concat(C("n_name")).alias("g"))


@_query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS g FROM orders GROUP BY o_custkey")
def group_concat_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.group_concat(C("o_orderstatus"), separator="|", distinct=True).alias("g"))


@_query("SELECT o_orderkey, CAST(o_totalprice > (SELECT min(o_totalprice) FROM orders WHERE o_orderstatus = 'P') AS INT) AS m FROM orders")
def any_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return compare_quantified(o, C("o_totalprice"), ">", o.where("o_orderstatus = 'P'"), "o_totalprice", False).select("o_orderkey", D.truth(C("matched")).alias("m"))


@_query("SELECT o_orderkey, CAST(o_totalprice >= (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'P') AS INT) AS m FROM orders")
def all_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return compare_quantified(o, C("o_totalprice"), ">=", o.where("o_orderstatus = 'P'"), "o_totalprice", True).select("o_orderkey", D.truth(C("matched")).alias("m"))


@_query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey <= 10 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal + 1 FROM supplier WHERE s_suppkey <= 5")
def odku(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    new = s.where("s_suppkey <= 10").unionByName(s.where("s_suppkey <= 5").withColumn("s_suppkey", C("s_suppkey") + 1000000).withColumn("s_acctbal", C("s_acctbal") + 1))
    return dml.on_duplicate_key_update(s, new, ["s_suppkey"], {"s_acctbal": F.col("t.s_acctbal") + 1})


@_query("SELECT * FROM supplier WHERE s_suppkey > 3 UNION ALL SELECT s_suppkey, 'new', s_nationkey, s_acctbal FROM supplier WHERE s_suppkey <= 3")
def replace_into(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return dml.replace(s, s.where("s_suppkey <= 3").withColumn("s_name", F.lit("new")), ["s_suppkey"])


@_query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS b FROM supplier WHERE NOT (s_nationkey = 3)")
def update_delete(spark, sf_dir):
    s = dml.update(table(spark, sf_dir, "supplier"), C("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})
    return dml.delete(s, C("s_nationkey") == 3).select("s_suppkey", C("s_acctbal").alias("b"))


from . import functions, relational, spatial, statements  # noqa: E402

for _part in (functions, relational, spatial, statements):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
