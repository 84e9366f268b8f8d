"""Correlated subqueries with ORDER BY and LIMIT keep their order where sorts spill, so that no shuffle delivers rows in order by chance."""

import os
import subprocess
import sys

from quern.frontend.translate import translate

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SPILLING = """
import duckdb, sys
from pyspark.sql import SparkSession
from __spark_entry__ import oracle_sql, queries
from quern.frontend.translate import translate
from quern.sources.tables import views

at = "/root/testdata/sf0.01"
spark = SparkSession.builder.master("local[4]").config("spark.shuffle.spill.numElementsForceSpillThreshold", "100").config("spark.ui.enabled", "false").getOrCreate()
views(spark, at)
duck = duckdb.connect()
for x in ("customer", "orders"):
    duck.sql(f"CREATE VIEW {x} AS SELECT * FROM '{at}/{x}.parquet'")
own = "(SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 1)"
lateral = "SELECT c_custkey, k FROM customer, LATERAL (SELECT o_orderkey AS k FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice % 7, k DESC LIMIT 3) t"
scalar = f"SELECT c_custkey, {own} AS second FROM customer"
pairs = [(queries()["join_lateral"](spark, at), oracle_sql()["join_lateral"])] + [(spark.sql(translate(x)), x) for x in (lateral, scalar)]
print("differ", sum(sorted(map(tuple, df.collect()), key=str) != sorted(duck.sql(sql).fetchall(), key=str) for df, sql in pairs))
"""


def test_order_where_sorts_spill():
    done = subprocess.run([sys.executable, "-c", SPILLING], capture_output=True, text=True, cwd=ROOT, timeout=300)
    assert done.stdout.strip().endswith("differ 0"), done.stdout + done.stderr[-2000:]


def test_keys_that_are_not_output(spark):
    rows = lambda text: [tuple(r) for r in spark.sql(translate(text)).collect()]
    t = "(SELECT 1 AS a, 9 AS b UNION ALL SELECT 2, 8 UNION ALL SELECT 3, 7) t"
    assert rows(f"SELECT * FROM (SELECT a FROM {t} ORDER BY b LIMIT 1) x") == [(3,)]
    assert rows(f"SELECT * FROM (SELECT a + 1 AS c FROM {t} ORDER BY c * -1, b LIMIT 2) x ORDER BY c") == [(3,), (4,)]
    assert rows(f"SELECT * FROM (SELECT a % 2 AS p, SUM(b) AS s FROM {t} GROUP BY a % 2 ORDER BY COUNT(*) DESC LIMIT 1) x") == [(1, 16)]
    assert rows(f"SELECT * FROM (SELECT DISTINCT a FROM {t} ORDER BY a DESC LIMIT 1) x") == [(3,)]
    assert rows(f"SELECT * FROM (SELECT * FROM {t} ORDER BY t.b, 1 LIMIT 1) x") == [(3, 7)]
    assert rows(f"SELECT (SELECT a FROM {t} ORDER BY b DESC LIMIT 1 OFFSET 1) AS v") == [(2,)]
