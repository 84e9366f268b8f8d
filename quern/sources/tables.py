"""Reading and writing tables; tab-separated loads with MySQL's defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Which folder's table a session's view of that name shows.
_shown: dict[tuple[int, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Temporary views of the tables that a statement names (of all, without one); nothing is read but footers, once a session and folder."""
    for name in NAMES if sql is None else [n for n in NAMES if re.search(rf"\b{n}\b", sql, re.I)]:
        at = (id(spark._jsparkSession), name)
        if _shown.get(at) != sf_dir or not spark.catalog.tableExists(name):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
            _shown[at] = sf_dir


def _unescaped(field: Column) -> Column:
    r"""\N alone is NULL; \0 \b \n \r \t \Z are control characters, any other escaped character stands for itself."""
    out = F.replace(field, F.lit("\\\\"), F.lit("\ue000"))
    for a, b in (("\\0", "\0"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\Z", "\x1a")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(field != "\\N", F.replace(F.regexp_replace(out, r"\\(.)", "$1"), F.lit("\ue000"), F.lit("\\")))


def load_data(spark: SparkSession, path: str, schema: str, ignore_lines: int = 0) -> DataFrame:
    r"""LOAD DATA INFILE of one file: fields end at tabs, \N is NULL, a backslash escapes, an empty field is an empty string (0 as a number).

    The first `ignore_lines` lines are skipped. Missing fields are NULL, further ones are left out.
    """
    lines = spark.read.text(path)
    if ignore_lines:  # the file's first part is the first partition
        lines = lines.withColumn("__at", F.monotonically_increasing_id()).where(F.col("__at") >= ignore_lines).drop("__at")
    parts = F.split(F.regexp_replace("value", r"((?:\\.|[^\\\t])*)\t", "$1\ue001"), "\ue001")
    out = []
    for i, f in enumerate(_parse_datatype_string(schema).fields):
        text = _unescaped(F.get(parts, F.lit(i)))
        kind = f.dataType.simpleString()
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        out.append((F.when(text == "", F.lit("0")).otherwise(text).try_cast(f.dataType) if number else text.try_cast(f.dataType)).alias(f.name))
    return lines.select(*out)


def save_data(df: DataFrame, path: str) -> None:
    r"""The file that load_data reads: tabs, \N, backslash escapes."""
    def field(c: str) -> Column:
        out = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for a, b in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.coalesce(out, F.lit("\\N"))

    df.select(F.concat_ws("\t", *(field(c) for c in df.columns)).alias("value")).write.text(path)
