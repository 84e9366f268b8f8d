"""Results of the dialect's functions at their edges."""

from pyspark.sql import functions as F

from quern.functions import aggregates as A
from quern.functions import dialect as D


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_strings(spark):
    s = F.lit("abcdef")
    assert one(spark, D.substring(s, F.lit(0), F.lit(3))) == ""
    assert one(spark, D.substring(s, F.lit(-9), F.lit(5))) == ""
    assert one(spark, D.trim(F.lit("ababX"), "ab")) == "X"
    assert one(spark, D.pad(F.lit("hi"), F.lit(5), F.lit(""), True)) == ""
    assert one(spark, D.quote(F.lit(None).cast("string"))) == "NULL"
    assert one(spark, D.from_base64(F.lit("!!!"))) is None
    assert one(spark, D.strcmp(F.lit("É"), F.lit("e"))) == 0
    assert one(spark, D.number(F.lit(" 12abc"))) == 12


def test_numbers(spark):
    assert one(spark, D.divide(F.lit(1), F.lit(0))) is None
    assert one(spark, D.greatest(F.lit(1), F.lit(None).cast("int"), F.lit(3))) is None
    assert str(one(spark, D.bit_not(F.lit(0)))) == "18446744073709551615"
    assert int(one(spark, D.shift_left(F.lit(1), F.lit(64)))) == 0
    assert one(spark, D.elt(F.lit(5), F.lit("a"))) is None


def test_dates(spark):
    d = F.lit("2000-01-01").cast("date")
    assert [one(spark, D.week(d, m)) for m in range(8)] == [0, 0, 52, 52, 0, 0, 52, 52]
    assert one(spark, D.to_days(d)) == 730485
    assert one(spark, D.date_format(d, "%D %w")) == "1st 6"


def test_aggregates_over_nothing(spark):
    none = spark.range(0).withColumn("x", F.col("id"))
    got = none.agg(A.bit_and(F.col("x")).alias("a"), A.bit_or(F.col("x")).alias("o"), A.group_concat(F.col("x")).alias("g")).first()
    assert (int(got["a"]), int(got["o"]), got["g"]) == ((1 << 64) - 1, 0, None)
