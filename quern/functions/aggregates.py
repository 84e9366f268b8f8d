"""Aggregates with MySQL results; each is an ordinary partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import UNSIGNED, unsigned


def sum_exact(c: Column, scale: int = 0) -> Column:
    """SUM of exact numbers of that scale: a decimal that doesn't overflow as a BIGINT would."""
    return F.sum(c.cast(f"decimal({20 + scale},{scale})"))


def avg_exact(c: Column, scale: int = 0) -> Column:
    """AVG of exact numbers of that scale: a decimal with four digits more."""
    return F.avg(c.cast(f"decimal({20 + scale},{scale})")).cast(f"decimal(30,{scale + 4})")


def std_samp(c: Column) -> Column:
    """NULL for fewer than two values."""
    return F.when(F.count(c) > 1, F.stddev_samp(c))


def var_samp(c: Column) -> Column:
    return F.when(F.count(c) > 1, F.var_samp(c))


def any_value(c: Column) -> Column:
    """Some value of the group, the least, so that it is the same in every run."""
    return F.min(c)


def json_objectagg(k: Column, v: Column) -> Column:
    """JSON_OBJECTAGG: of several values of a key the largest stays; keys go by length, then by bytes; no rows give NULL."""
    pairs = F.array_sort(F.collect_set(F.struct(F.octet_length(k.cast("string")).alias("n"), k.cast("string").alias("k"), v.alias("v"))))
    last = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i + 1)["k"] != x["k"], F.lit(True)))
    one = F.transform(last, lambda x: F.concat(F.to_json(F.array(x["k"])).substr(F.lit(2), F.octet_length(F.to_json(F.array(x["k"]))) - 2), F.lit(": "), F.coalesce(F.regexp_extract(F.to_json(F.array(x["v"])), r"(?s)^\[(.*)\]$", 1), F.lit("null"))))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}")))


def std(c: Column) -> Column:
    return F.stddev_pop(c)


def variance(c: Column) -> Column:
    return F.var_pop(c)


def bit_and(c: Column) -> Column:
    """All ones over no rows."""
    return F.coalesce(unsigned(F.bit_and(c.cast("bigint"))), F.lit(str((1 << 64) - 1)).cast(UNSIGNED))


def bit_or(c: Column) -> Column:
    return F.coalesce(unsigned(F.bit_or(c.cast("bigint"))), F.lit(0).cast(UNSIGNED))


def bit_xor(c: Column) -> Column:
    return F.coalesce(unsigned(F.bit_xor(c.cast("bigint"))), F.lit(0).cast(UNSIGNED))


def group_concat(c: Column, order: Column | None = None, separator: str = ",", distinct: bool = False, most: int = 1024) -> Column:
    """GROUP_CONCAT: NULLs are skipped, the result is cut at group_concat_max_len, no rows give NULL."""
    one = F.struct((c if order is None else order).alias("o"), c.cast("string").alias("v"))
    some = F.collect_set(F.when(c.isNotNull(), one)) if distinct else F.collect_list(F.when(c.isNotNull(), one))
    text = F.array_join(F.transform(F.array_sort(some), lambda x: x["v"]), separator)
    cut = F.regexp_replace(F.call_function("make_valid_utf8", F.substring(text.cast("binary"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.size(some) > 0, F.when(F.octet_length(text) <= most, text).otherwise(cut))


def json_arrayagg(c: Column, order: Column) -> Column:
    """JSON_ARRAYAGG with JSON nulls kept; no rows give NULL."""
    some = F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v"))))
    return F.when(F.size(some) > 0, F.to_json(F.transform(some, lambda x: x["v"])))
