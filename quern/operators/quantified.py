"""op ANY and op ALL over a subquery, by its least, largest, count and nulls: one row, whatever its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_quantified(outer: DataFrame, value: Column, op: str, inner: DataFrame, column: str, every: bool) -> DataFrame:
    """outer with `matched`: true, false or NULL in three-valued logic; op is one of < <= > >=."""
    s = inner.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"), F.count("*").alias("__n"), F.count(column).alias("__k"))
    edge = ("__lo" if op[0] == "<" else "__hi") if every else ("__hi" if op[0] == "<" else "__lo")
    test = {"<": value < F.col(edge), "<=": value <= F.col(edge), ">": value > F.col(edge), ">=": value >= F.col(edge)}[op]
    nulls = F.col("__n") > F.col("__k")
    if every:
        out = F.when(F.col("__n") == 0, True).when(test == F.lit(False), False).when(nulls | value.isNull(), None).otherwise(test)
    else:
        out = F.when(F.col("__n") == 0, False).when(test, True).when(nulls | value.isNull(), None).otherwise(F.coalesce(test, F.lit(False)))
    return outer.join(F.broadcast(s)).withColumn("matched", out).drop("__lo", "__hi", "__n", "__k")
