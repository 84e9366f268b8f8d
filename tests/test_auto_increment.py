"""AUTO_INCREMENT over many rows and repeated values."""

import pytest
from pyspark.sql import functions as F

from quern.operators import dml
from quern.plans.registry import QUERIES


def test_numbers_are_dealt_once_and_in_order(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.lit(None).cast("long").alias("id"), F.xxhash64("id").alias("v"))
    got = dml.with_auto_increment(spark.createDataFrame([(7,)], "id long"), rows, "id", ["v"])
    ids = [r.id for r in got.orderBy("v").select("id").collect()]
    assert ids == list(range(8, 200_008))


@pytest.mark.parametrize("values", [[], [None], [None, None, 1.0, 1.0, float("nan")], [3.0] * 5])
def test_ties_and_nulls(spark, values):
    rows = spark.createDataFrame([(None, v) for v in values] + [(4, 0.0)], "id long, v double")
    got = dml.with_auto_increment(spark.createDataFrame([], "id long"), rows, "id", ["v"]).collect()
    assert sorted(r.id for r in got) == list(range(4, 5 + len(values)))


def test_query_with_repeated_names(spark, tmp_path):
    rows = [(k, f"name {k % 3}", 1, 0.0, "x") for k in range(30)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r.id, r.c_name) for r in QUERIES["auto_increment"](spark, str(tmp_path)).collect()}
    assert got == {(30 + k // 5 if k % 5 == 0 else k, name) for k, name, *_ in rows}
