"""Rows of equal values in a batch share one call of a spatial function."""

import uuid

from pyspark.sql import functions as F

from quern.functions import spatial as G


def test_equal_rows_share_a_call(spark):
    rows = spark.range(0, 300, 1, 1).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("s"))
    got = rows.select("s", G._apply(lambda s: f"{s} {uuid.uuid4()}", "string", F.col("s")).alias("u")).distinct().collect()
    assert sorted(r.s or "" for r in got) == ["", "1", "2"] and all((r.u is None) == (r.s is None) for r in got)


def test_negative_zero_and_arrays(spark):
    signs = spark.createDataFrame([(0.0,), (-0.0,)], "x double").coalesce(1)
    assert {r[0] for r in signs.select(F.hex(G.point(F.col("x"), F.col("x")))).collect()} == {"00000000" + "0101000000" + z * 2 for z in ("0000000000000000", "0000000000000080")}
    some = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 2.0)], "k int, x double")
    got = some.groupBy("k").agg(G.st_collect(G.point(F.col("x"), F.col("x"))).alias("g")).select("k", G.st_as_text("g").alias("t")).collect()
    assert {(r.k, r.t) for r in got} == {(1, "MULTIPOINT((0 0),(1 1))"), (2, "MULTIPOINT((2 2))")}


def test_no_rows(spark):
    assert spark.range(0).select(G.st_as_text(G.geom_from_text(F.lit("POINT(1 1)")))).collect() == []
