"""Pieces shared by the training-data operators: session settings, scratch tables, pre-tokens, connected groups."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Long texts make rows heavy, so batches are short.
ARROW_ROWS = 512


def tune(spark: SparkSession) -> SparkSession:
    """Session settings that every operator here assumes: short Arrow batches, AQE with skew splitting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a fresh local one where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the JVM may be gone when the interpreter ends; the shared folder has its own cleaning
        return


#: Paths of the tables that the present stage of a pipeline has written, where one is running, and those of earlier stages.
_own: list[list[str]] = []
_earlier: list[str] = []


def stage(spark: SparkSession, docs: DataFrame, step) -> DataFrame:
    """step(), a stage of a pipeline over docs. Tables that earlier stages wrote for themselves are removed, but for those that docs still reads."""
    read = docs.inputFiles() if _earlier else []
    for path in [p for p in _earlier if not any(p.split("/")[-1] in f for f in read)]:
        _earlier.remove(path)
        _remove(spark, path)
    _own.append([])
    try:
        return step()
    finally:
        _earlier.extend(_own.pop())


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends, or when a pipeline's next stage begins."""
    path = f"{shared_dir(spark)}/quern-{what}-{uuid.uuid4().hex}"
    if _own:
        _own[-1].append(path)
    atexit.register(_remove_late, spark, path)
    return path


def trim(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap (by its compilers, by compression) back to the system. False where the JVM has no such command."""
    sc = spark.sparkContext
    kind, array = sc._jvm.java.lang.Class.forName, sc._gateway.new_array
    types, args = array(sc._jvm.java.lang.Class, 4), array(sc._jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = kind(name)
    try:
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # other JVMs, other systems
        return False
    return True


def free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, whose results are written tables by now, and the driver's JVM give back memory.

    Just after a step something still refers to its shuffles, which one collection leaves alone; a second one a little later finds them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()
    trim(spark)


class Scratch:
    """A table written to the shared folder, which cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, what)
        df.write.option("compression", "zstd").parquet(self.path)
        free(self.spark)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def written(df: DataFrame, what: str) -> DataFrame:
    return Scratch(df, what).df


def even(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark sizes a written table by its compressed files and rows after an explode by those before it; as a hash table in the driver
    they can take a hundred times that.
    """
    return df.hint("merge")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected groups of an undirected graph: (u, v) of an orderable type -> (node, root), root the least node of the group.

    Alternating large-star and small-star steps by minimum and join only: no neighbour list is
    gathered, so a node with very many edges is an ordinary skewed key, combined before the shuffle
    and split by AQE in the join. Each round is a written table. Null ends and loops are ignored;
    no edges give no rows. Raises RuntimeError when it has not settled after `rounds` rounds (the
    number needed grows with the logarithm of the group size).
    """
    e = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    kept = Scratch(e, "edges")
    last = None
    for _ in range(rounds):
        e = kept.df
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(even(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(even(low2), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = Scratch(small, "edges")
        now = tuple(new.df.agg(F.count("*"), F.count_distinct("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        kept.drop()
        kept = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"connected: not settled after {rounds} rounds")
    roots = kept.df.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return kept.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _ranges(category: str) -> str:
    """The inside of a character class: all code points of a Unicode category, as ranges."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = []
    for run in regex.findall(rf"{category}+", every):
        a = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or ord(run[i]) != ord(run[i - 1]) + 1:
                out.append(re.escape(run[a]) + ("-" + re.escape(run[i - 1]) if i - a > 1 else ""))
                a = i
    return "".join(out)


#: White space as the Unicode property White_Space has it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=1)
def pretoken_pattern() -> re.Pattern:
    """The split pattern of the rank files, with its classes spelled out for the standard library's faster engine."""
    letter, number = _ranges(r"\p{L}"), _ranges(r"\p{N}")
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def pieces(text: str, part: int = 1 << 22) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists that together stay small against a very long text."""
    pattern = pretoken_pattern()
    if len(text) <= part:
        yield pattern.findall(text)
        return
    out: list[str] = []
    for m in pattern.finditer(text):
        out.append(m[0])
        if len(out) >= 1 << 18:
            yield out
            out = []
    yield out
