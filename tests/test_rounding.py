"""Rounding of doubles as printf in C does it."""

from decimal import Decimal

from pyspark.sql import functions as F

from quern.functions import scalar as S


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_format_bytes_halves(spark):
    got = one(spark, *(S.format_bytes(F.lit(n)) for n in (1152 << 20, 1664 << 20, 1152, -1152, 1023, 1023 << 10, (1 << 50) - 1)))
    assert got == ["1.12 GiB", "1.62 GiB", "1.12 KiB", "-1.12 KiB", "1023 bytes", "1023.00 KiB", "1024.00 TiB"]


def test_format_doubles(spark):
    got = one(spark, *(S.format_(F.lit(x), 2) for x in (-0.0, -0.001, 0.125, 1234.5, Decimal("0.125"))))
    assert got == ["-0.00", "-0.00", "0.12", "1,234.50", "0.13"]
