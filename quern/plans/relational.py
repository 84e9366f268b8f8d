"""Registered queries of statements: joins, common table expressions, collation in grouping, windows, writes, loads."""

from __future__ import annotations

import uuid
from tempfile import gettempdir

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import aggregates as A
from ..functions import dialect as D
from ..operators import dml
from ..sources.tables import load_data, save_data, table, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


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


for _name, _text in {
    "dual_select": "SELECT 1 + 1 AS a, 'x' AS b, CAST(NULL AS INT) AS c",
    "table_statement": "SELECT * FROM (TABLE region)",
    "join_full": "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey < 30) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_suppkey > 3) s ON c_custkey = s_suppkey",
    "join_using": "SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1) x JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) y USING (k)",
    "join_natural": "SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1) x NATURAL LEFT JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) y",
    "cte_chain": "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b",
    "having_alias": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12",
    "null_join_rows": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey < 50 WHERE o_orderkey IS NOT DISTINCT FROM NULL",
    "not_in_rows": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 50)",
    "anti_exists_rows": "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_orderkey < 20)",
    "count_distinct_row": "SELECT o_orderstatus, count(DISTINCT o_custkey, o_orderpriority) AS n FROM orders GROUP BY o_orderstatus",
    "distinct_aggs": "SELECT o_orderpriority, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, min(DISTINCT o_custkey) AS lo, max(DISTINCT o_custkey) AS hi, round(avg(DISTINCT o_custkey), 4) AS a FROM orders GROUP BY o_orderpriority",
    "stddev_family": "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS s, round(var_samp(o_custkey), 3) AS v, round(stddev_pop(o_custkey), 3) AS p FROM orders GROUP BY o_orderstatus",
    "win_stat_agg": "SELECT o_orderkey, round(stddev_pop(o_custkey) OVER (PARTITION BY o_orderstatus), 4) AS s, round(var_pop(o_custkey) OVER (PARTITION BY o_orderstatus), 3) AS v FROM orders",
    "win_expression": "SELECT o_orderkey, sum(o_custkey * 2 + 1) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM orders",
    "order_rank_nulls": "SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey NULLS FIRST, c_custkey) AS r FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "order_rank_multi": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) AS r FROM orders",
    "order_expression": "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 7, -o_totalprice, o_orderkey) AS r FROM orders",
    "case_compare": "SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS w FROM customer",
    "scalar_projection": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer",
    "set_mixed": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
}.items():
    _sql(_name, _text)
_sql("count_distinct_row", "SELECT o_orderstatus, count(DISTINCT o_custkey, o_orderpriority) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM orders GROUP BY o_orderstatus")
# Spark numbers the rows of a correlated query by its order only if all keys are output; else it relies on the order in which a shuffle delivers them
_sql("join_lateral", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
_sql("join_straight", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
_sql("rollup_two", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, c_name FROM t JOIN customer ON c_custkey = n")


@_query("SELECT lower(c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY 1")
def group_collation(spark, sf_dir):
    """Keys that differ in case and accents only are one group."""
    c = table(spark, sf_dir, "customer").withColumn("s", F.when(C("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(C("c_mktsegment")))
    return c.groupBy(D.ci(C("s")).alias("g")).agg(F.count("*").alias("n")).select(F.lower(F.collate("g", "UTF8_BINARY")).alias("k"), "n")


@_query("SELECT count(DISTINCT c_mktsegment) AS d, count(DISTINCT c_mktsegment) AS u, count(*) AS n FROM customer")
def distinct_collation(spark, sf_dir):
    """DISTINCT and UNION compare by collation, COUNT(DISTINCT) too."""
    c = table(spark, sf_dir, "customer")
    both = c.select(D.ci(C("c_mktsegment")).alias("s")).union(c.select(D.ci(F.lower("c_mktsegment")).alias("s")))
    return both.distinct().agg(F.count("*").alias("d")).crossJoin(c.agg(F.count_distinct(D.ci(F.initcap("c_mktsegment"))).alias("u"), F.count("*").alias("n")))


@_query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS r FROM customer")
def order_collation(spark, sf_dir):
    s = D.ci(F.when(C("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(C("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(Window.orderBy(s, "c_custkey")).alias("r"))


@_query("SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END, c_custkey) AS r FROM customer")
def order_field(spark, sf_dir):
    by = D.field(C("c_mktsegment"), F.lit("machinery"), F.lit("building"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(Window.orderBy(by, "c_custkey")).alias("r"))


@_query("SELECT o_orderkey, bit_and(o_custkey) OVER w AS a, bit_or(o_custkey) OVER w AS o, bit_xor(o_custkey) OVER w AS x FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def win_bit_agg(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rowsBetween(-3, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bit_and("o_custkey").over(w).alias("a"), F.bit_or("o_custkey").over(w).alias("o"), F.bit_xor("o_custkey").over(w).alias("x"))


@_query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) / count(*), 4) AS DOUBLE) AS a FROM orders GROUP BY o_orderstatus")
def sum_avg_decimal(spark, sf_dir):
    p = C("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(A.sum_exact(p, 2).cast("double").alias("s"), F.round(A.avg_exact(p, 2), 4).cast("double").alias("a"))


@_query("SELECT c_nationkey, min(c_name) AS a, CASE WHEN count(*) > 1 THEN round(stddev_samp(c_acctbal), 3) END AS s FROM customer GROUP BY c_nationkey")
def any_value(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(A.any_value(C("c_name")).alias("a"), F.round(A.std_samp(C("c_acctbal")), 3).alias("s"))


@_query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\": ' || n_nationkey, ', ' ORDER BY length(n_name), n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def json_objectagg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.json_objectagg(C("n_name"), C("n_nationkey")).alias("j"))


@_query("SELECT n_regionkey, '[' || string_agg(CASE WHEN n_nationkey % 3 = 0 THEN 'null' ELSE CAST(n_nationkey AS VARCHAR) END, ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def json_arrayagg(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("v", F.when(C("n_nationkey") % 3 != 0, C("n_nationkey")))
    return n.groupBy("n_regionkey").agg(A.json_arrayagg(C("v"), C("n_nationkey")).alias("j"))


@_query("SELECT n_regionkey, left(string_agg(repeat(n_name, 40), ',' ORDER BY n_name), 1024) AS g FROM nation GROUP BY n_regionkey")
def group_concat_limit(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.group_concat(F.repeat("n_name", 40), C("n_name")).alias("g"))


@_query("SELECT event_id, i AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) + i AS v FROM events, (SELECT unnest([1, 2]) AS i)")
def json_table(spark, sf_dir):
    from ..functions import json as J

    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.to_json(F.array(F.struct((k + 1).alias("v")), F.struct((k + 2).alias("v"))))
    return J.json_table(e.select("event_id", doc.alias("doc")), C("doc"), "$[*]", {"v": ("$.v", "bigint")}, "pos").select("event_id", C("pos").cast("bigint").alias("pos"), "v")


# writes
@_query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, NULL FROM customer")
def insert_select(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select((C("c_custkey") + 1000000).alias("s_suppkey"), C("c_name").alias("s_name"), C("c_nationkey").alias("s_nationkey"))
    return dml.insert(table(spark, sf_dir, "supplier"), new)


@_query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, 'first' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT NULL, 'free' FROM customer WHERE c_custkey < 3")
def insert_ignore(spark, sf_dir):
    """Of new rows with one key the first is put in; keys that are NULL conflict with none."""
    c = table(spark, sf_dir, "customer")
    one = lambda name, at: c.select(C("c_custkey").alias("s_suppkey"), F.lit(name).alias("s_name"), F.lit(at).alias("at"))
    free = c.where("c_custkey < 3").select(F.lit(None).cast("bigint").alias("s_suppkey"), F.lit("free").alias("s_name"), F.lit(3).alias("at"))
    return dml.insert_ignore(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), one("second", 2).union(one("first", 1)).union(free), ["s_suppkey"], ["at"])


@_query("SELECT s_suppkey, CASE WHEN s_suppkey < 5 THEN 'last' ELSE s_name END AS s_name FROM supplier")
def replace_repeated(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = lambda name, at: s.where("s_suppkey < 5").withColumn("s_name", F.lit(name)).withColumn("at", F.lit(at))
    return dml.replace(s, new("last", 2).union(new("first", 1)), ["s_suppkey"], ["at"])


@_query("SELECT s_suppkey, CASE WHEN s_suppkey < 5 THEN s_nationkey + 3 ELSE s_nationkey END AS s_nationkey FROM supplier UNION ALL SELECT -1, 9")
def odku_repeated(spark, sf_dir):
    """Three new rows of a key: an old row is raised by each; without an old row the first is put in and raised twice."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    new = s.where("s_suppkey < 5").unionAll(spark.createDataFrame([(-1, 7)], s.schema)).crossJoin(spark.range(3).toDF("at"))
    return dml.on_duplicate_key_update(s, new, ["s_suppkey"], {"s_nationkey": C("t.s_nationkey") + 1}, ["at"])


@_query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'in 1' ELSE s_name END AS s_name FROM supplier")
def update_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    n = table(spark, sf_dir, "nation")
    out = dml.update_joined(s, n, (C("t.s_nationkey") == C("o.n_nationkey")) & (C("o.n_regionkey") == 1), {"s_name": F.concat(F.lit("in "), C("o.n_regionkey"))}, ["s_suppkey"])
    return out.select("s_suppkey", "s_name")


@_query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_join(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return dml.delete_joined(s, n, (C("t.s_nationkey") == C("o.n_nationkey")) & (C("o.n_regionkey") == 1)).select("s_suppkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 7)")
def delete_order_limit(spark, sf_dir):
    return dml.delete_first(table(spark, sf_dir, "orders"), C("o_orderstatus") == "F", [F.desc("o_totalprice"), C("o_orderkey")], 7).select("o_orderkey")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 9) THEN 'X' ELSE o_orderstatus END AS s FROM orders")
def update_order_limit(spark, sf_dir):
    out = dml.update_first(table(spark, sf_dir, "orders"), C("o_orderstatus") == "F", [C("o_orderkey")], 9, {"o_orderstatus": F.lit("X")})
    return out.select("o_orderkey", C("o_orderstatus").alias("s"))


@_query("SELECT count(*) FILTER (c_custkey < 0) AS n, count(*) AS whole FROM customer")
def truncate_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return dml.truncate(c).agg(F.count("*").alias("n")).crossJoin(c.agg(F.count("*").alias("whole")))


@_query("SELECT CASE WHEN c_custkey % 5 = 0 THEN CAST((SELECT max(c_custkey) FROM customer) + 1 + c_custkey // 5 AS BIGINT) ELSE c_custkey END AS id, c_name FROM customer")
def auto_increment(spark, sf_dir):
    """Rows without a number get those after the largest, in order."""
    c = table(spark, sf_dir, "customer")
    old = c.agg(F.max("c_custkey").alias("id"))
    new = c.select(F.when(C("c_custkey") % 5 != 0, C("c_custkey")).alias("id"), "c_name", "c_custkey")
    return dml.with_auto_increment(old, new, "id", ["c_custkey"]).drop("c_custkey")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10")
def foreign_key_cascade(spark, sf_dir):
    """DELETE of parents takes their children along."""
    return dml.delete_parents(table(spark, sf_dir, "customer"), C("c_custkey") < 10, ["c_custkey"], table(spark, sf_dir, "orders"), ["o_custkey"], "cascade")[1].select("o_orderkey", "o_custkey")


@_query("SELECT o_orderkey, CASE WHEN o_custkey >= 10 THEN o_custkey END AS o_custkey FROM orders")
def foreign_key_set_null(spark, sf_dir):
    return dml.delete_parents(table(spark, sf_dir, "customer"), C("c_custkey") < 10, ["c_custkey"], table(spark, sf_dir, "orders"), ["o_custkey"], "set null")[1].select("o_orderkey", "o_custkey")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey < 10)")
def foreign_key_check(spark, sf_dir):
    """Children without a parent."""
    return dml.foreign_key_violations(table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer").where("c_custkey >= 10"), ["c_custkey"]).select("o_orderkey")


@_query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 0")
def check_constraint(spark, sf_dir):
    """Rows that a CHECK rejects; where it is NULL they pass."""
    return dml.check_violations(table(spark, sf_dir, "customer"), F.when(C("c_custkey") % 2 == 0, C("c_acctbal") >= 0)).select("c_custkey")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name || chr(9) || 'a\\' || chr(10) || 'b' END AS s, c_acctbal FROM customer")
def load_data_round_trip(spark, sf_dir):
    """A file of tabs, escapes, empty fields and NULLs, written and loaded again."""
    text = F.when(C("c_custkey") % 3 == 1, "").when(C("c_custkey") % 3 == 2, F.concat("c_name", F.lit("\ta\\\nb")))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        shared = f"file://{gettempdir()}"
    path = f"{shared.rstrip('/')}/quern-load-{uuid.uuid4().hex}"
    save_data(table(spark, sf_dir, "customer").select("c_custkey", text.alias("s"), "c_acctbal"), path)
    return load_data(spark, path, "c_custkey bigint, s string, c_acctbal double")


@_query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def create_table_as(spark, sf_dir):
    """CREATE TABLE ... AS SELECT into a session table, read back."""
    name = f"t_{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).createOrReplaceTempView(name)
    return spark.table(name)
