"""Writes as snapshots: each takes the table's DataFrame and returns its next state.

Rows of one statement come in an order where that matters (REPLACE, IGNORE, ON DUPLICATE KEY): `order` names
columns that give it; without it, it is the order in which Spark reads the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that rows don't have are NULL."""
    return table.unionByName(rows.select([c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def _complete(keys: list[str]) -> Column:
    """Keys with a NULL never conflict."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _ranked(rows: DataFrame, keys: list[str], order: list[str] | None, last: bool) -> DataFrame:
    """rows with __rank: 1 for the first (or last) of a key."""
    by = [F.col(c) for c in order] if order else [F.monotonically_increasing_id()]
    rows = rows.withColumn("__at", F.struct(*by))
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__at") if last else F.asc("__at")))).drop("__at")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose key is there already, or came before in rows, are left out; a key with a NULL conflicts with none."""
    free = rows.where(~_complete(keys))
    first = _ranked(rows.where(_complete(keys)), keys, order, False).where("__rank = 1").join(table.select(keys), keys, "left_anti")
    return table.unionByName(free.select(table.columns)).unionByName(first.select(table.columns))


def replace(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Of new rows with one key the last stays, and it takes the place of the old one."""
    free = rows.where(~_complete(keys))
    last = _ranked(rows.where(_complete(keys)), keys, order, True).where("__rank = 1")
    return table.join(rows.select(keys), keys, "left_anti").select(table.columns).unionByName(last.select(table.columns)).unionByName(free.select(table.columns))


def on_duplicate_key_update(table: DataFrame, rows: DataFrame, keys: list[str], updates: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """updates may refer to the columns of `t` (old) and `n` (new values). New rows of one key are applied one after another.

    One pass for each row of the key that has most: a job counts them first.
    """
    free = rows.where(~_complete(keys)).select(table.columns)
    ranked = _ranked(rows.where(_complete(keys)), keys, order, False)
    passes = ranked.agg(F.max("__rank")).first()[0] or 0
    for k in range(1, passes + 1):
        t, n = table.alias("t"), ranked.where(F.col("__rank") == k).select(table.columns).alias("n")
        both = t.join(n, [F.col(f"t.{c}") == F.col(f"n.{c}") for c in keys], "full")
        new = F.col(f"n.{keys[0]}").isNotNull()
        old = F.col(f"t.{keys[0]}").isNotNull()
        pick = lambda c: F.when(old & new, updates.get(c, F.col(f"t.{c}"))).when(new, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}"))  # noqa: B023, E731
        table = both.select(*(pick(c).alias(c) for c in table.columns))
    return table.unionByName(free)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return table.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def update_joined(table: DataFrame, other: DataFrame, on: Column, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """UPDATE t JOIN o: rows of table (aliased t) that match one of other (aliased o) change, each once; `keys` identify table's rows."""
    hit = table.alias("t").join(other.alias("o"), on).select(*(F.col(f"t.{k}").alias(k) for k in keys), *(v.alias(f"__new_{c}") for c, v in values.items()))
    hit = hit.groupBy(*keys).agg(*(F.min(F.struct(F.col(f"__new_{c}"))).alias(f"__new_{c}") for c in values))
    out = table.join(hit, keys, "left")
    return out.select(*(F.when(F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}")[f"__new_{c}"]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """A row stays where the predicate is NULL."""
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_joined(table: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """DELETE t FROM t JOIN o: rows of table (aliased t) that match some row of other (aliased o) go."""
    return table.alias("t").join(other.alias("o"), on, "left_anti")


def delete_first(table: DataFrame, where: Column, order: list[Column], n: int) -> DataFrame:
    """DELETE ... WHERE ... ORDER BY ... LIMIT n."""
    hit = F.coalesce(where, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(hit).orderBy(*order))
    return table.withColumn("__hit", hit).withColumn("__rank", rank).where(~(F.col("__hit") & (F.col("__rank") <= n))).drop("__hit", "__rank")


def update_first(table: DataFrame, where: Column, order: list[Column], n: int, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... WHERE ... ORDER BY ... LIMIT n."""
    hit = F.coalesce(where, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(hit).orderBy(*order))
    return update(table.withColumn("__hit", hit & (rank <= n)), F.col("__hit"), values).drop("__hit")


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def with_auto_increment(table: DataFrame, rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """rows with `column` filled where it is NULL or 0: numbers go on after the largest of table and rows, in `order`.

    Numbers are dealt in two steps, counts per range of `order` first, so that no task sees all rows. Bounds of
    ranges come from a sample by hash, so that both passes cut alike; ties in `order` go by a hash of the row.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = F.coalesce(F.col(column), F.lit(0)) == 0
    last, n = rows.agg(F.max(column), F.count_if(need)).first()
    high = F.lit(max(0, last or 0, table.agg(F.max(column)).first()[0] or 0))
    some, place = rows.where(need), F.struct(*order)
    sample = some.where(F.pmod(F.xxhash64(*order), F.lit(max(1, n // (parts * 50)))) == 0).agg(F.array_sort(F.collect_set(place)).alias("__all"))
    step = F.ceil(F.size("__all") / parts).cast("int")
    bounds = sample.select(F.when(F.size("__all") > 0, F.filter("__all", lambda _, i: i % step == 0)).otherwise(F.col("__all")).alias("__bounds"))
    at = some.crossJoin(F.broadcast(bounds)).withColumn("__part", F.size(F.filter("__bounds", lambda x: x <= place))).drop("__bounds")
    sizes = {r["__part"]: r["n"] for r in at.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    start, starts = 0, {}
    for p in sorted(sizes):
        starts[p], start = start, start + sizes[p]
    base = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.col("__part")] if starts else F.lit(0)
    at = at.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order, F.xxhash64(*rows.columns))))
    numbered = at.withColumn(column, (high + base + F.col("__in")).cast(rows.schema[column].dataType)).drop("__part", "__in")
    return rows.where(~need).unionByName(numbered.select(rows.columns))


def check_violations(rows: DataFrame, check: Column) -> DataFrame:
    """Rows for which a CHECK is false; a NULL passes."""
    return rows.where(~F.coalesce(check, F.lit(True)))


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, referenced: list[str]) -> DataFrame:
    """Rows of child whose complete key has no row in parent."""
    keys = parent.select(*(F.col(r).alias(c) for c, r in zip(columns, referenced))).distinct()
    return child.where(_complete(columns)).join(keys, columns, "left_anti").select(child.columns)


def delete_parents(parent: DataFrame, where: Column, referenced: list[str], child: DataFrame, columns: list[str], action: str) -> tuple[DataFrame, DataFrame]:
    """(parent, child) after a DELETE on parent under ON DELETE `action`: cascade, set null, or restrict, which raises if a child is hit."""
    gone = parent.where(F.coalesce(where, F.lit(False))).select(*(F.col(r).alias(c) for c, r in zip(columns, referenced))).distinct()
    left = delete(parent, where)
    if action == "cascade":
        return left, child.join(gone, columns, "left_anti").select(child.columns)
    if action == "set null":
        marked = child.join(gone.withColumn("__gone", F.lit(True)), columns, "left")
        return left, marked.select(*(F.when(F.col("__gone"), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in child.columns))
    if not child.join(gone, columns, "left_semi").isEmpty():
        raise ValueError("1451: a row of the child table refers to a deleted row")
    return left, child
