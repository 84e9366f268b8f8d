"""I-Match fingerprints, in DataFrame operations only.

A text's terms are its distinct lower-case words, hashed to slots. Terms of the whole corpus are
counted per slot; the lexicon is the slots whose inverse document frequency lies in a band. A
fingerprint hashes the sorted lexicon terms of a text once for each of several random subsets of the
lexicon, of falling density, and all its terms once more. Two fingerprints are as like as the share of
subsets, not empty in both, on which they agree.

The lexicon is a bitmap of SLOTS bits, whatever the size of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tune

SLOTS = 1 << 18
#: Largest share of documents that a lexicon term may be in, and lexicon terms that a document has on average.
COMMON, TERMS = 0.05, 32.0
#: Subsets for each density 1/2, 1/4, ... and how many densities.
EACH, DENSITIES = 8, 7
#: Documents in a run of neighbours, and the most runs.
RUN, RUNS = 1000, 8192


def terms(text: Column) -> Column:
    """The slots of a text's distinct words, ascending."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    slots = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)))
    return F.array_sort(F.array_distinct(slots))


def lexicon(docs: DataFrame, common: float = COMMON, target: float = TERMS) -> tuple[list[int], float, float]:
    """(bitmap of slots as longs, least and largest inverse document frequency of the band).

    From the band's common end, slots enter in order of falling frequency until a document has
    `target` of them on average; slots of one frequency enter together. All documents count.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("slot")).groupBy("slot").agg(F.count("*").alias("df"))
    by = df.where(F.col("df") <= max(1, common * n)).groupBy("df").agg(F.count("*").alias("slots")).orderBy(F.desc("df"))
    least, mass = 0, 0.0
    for r in by.toLocalIterator():  # at most SLOTS rows, read until the target is met
        least, mass = r["df"], mass + r["df"] * r["slots"]
        if mass >= target * n:
            break
    bits = np.zeros(SLOTS, np.uint8)
    if least:
        bits[[r["slot"] for r in df.where((F.col("df") <= max(1, common * n)) & (F.col("df") >= least)).select("slot").collect()]] = 1
    packed = np.packbits(bits, bitorder="little").view("<i8").tolist()
    return packed, math.log(1 / common), math.log(n / least) if least else 0.0


def fingerprint(text: Column, bitmap: Column) -> Column:
    """array<string>: a hash per subset, '' where the text has no term of it, and one of all terms."""
    every = terms(text)
    inside = lambda t: F.call_function("shiftrightunsigned", F.get(bitmap, F.shiftright(t, 6).cast("int")), F.pmod(t, F.lit(64)).cast("int")).bitwiseAND(1) == 1
    kept = F.filter(every, inside)
    named = F.transform(F.array(F.struct(kept.alias("kept"))), lambda s: F.transform(_subsets(s["kept"]), lambda x: F.when(F.size(x) == 0, "").otherwise(_hash(x))))[0]
    return F.concat(named, F.array(_hash(every)))


def _subsets(kept: Column) -> Column:
    def one(j: Column) -> Column:
        level = (j / EACH).cast("int")
        return F.filter(kept, lambda t: _bits(t, level, F.pmod(j, F.lit(EACH)).cast("int")) == 0)

    return F.transform(F.sequence(F.lit(0), F.lit(EACH * DENSITIES - 1)), one)


def _bits(t: Column, level: Column, i: Column) -> Column:
    """The i-th group of level + 1 bits of a hash of t that depends on the level."""
    return F.call_function("shiftrightunsigned", F.xxhash64(t, level), i * (level + 1)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level + 1) - 1)


def _hash(x: Column) -> Column:
    return F.lower(F.hex(F.pmod(F.xxhash64(x), F.lit(1 << 32))))


def _literal(bitmap: list[int]) -> Column:
    """The bitmap as a constant of the plan (the optimizer folds it once)."""
    return F.expr(f"from_json('{bitmap}', 'array<bigint>')")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets among those that are not empty in both fingerprints."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != ""))
    return F.size(F.filter(some, lambda p: p["a"] == p["b"])) / F.size(some)


def with_next(docs: DataFrame, columns: list[str], add=lambda df: df) -> DataFrame:
    """docs with next_<column> for each of columns: the values of the next row by (doc_id, text), of the first after the last.

    Rows are dealt into runs of neighbours by quantiles of doc_id, in which a window looks ahead; the
    first row of each run is copied to the end of the run before. Null ids come first; equal rows
    follow each other. add() puts columns in, once the copies are there: columns may name these too.
    """
    n = docs.count()
    runs = min(RUNS, max(1, math.ceil(n / RUN)))
    ids = docs.select("doc_id")
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)], 10 * RUNS)).first()[0] or [])) if runs > 1 else []
    at = F.lit(0)
    if cuts:
        edges, steps = F.array(*map(F.lit, cuts)), len(cuts).bit_length()
        at = F.lit(0)
        step = lambda acc, k: F.when((acc + k <= len(cuts)) & (F.get(edges, acc + k - 1) <= F.col("doc_id")), acc + k).otherwise(acc)
        at = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(steps)))), F.lit(0), step)
    dealt = docs.withColumn("__run", at).withColumn("__copy", F.lit(False))
    firsts = sorted(dealt.groupBy("__run").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).select("__run", "m.doc_id").collect(), key=lambda r: r[0])
    if not firsts:
        return add(docs).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    spark = docs.sparkSession
    back = spark.createDataFrame([(r[0], r[1], firsts[k - 1][0]) for k, r in enumerate(firsts)], "__run int, __id long, __to int")
    head = dealt.join(F.broadcast(back), (dealt["__run"] == back["__run"]) & dealt["doc_id"].eqNullSafe(back["__id"])).drop(back["__run"])
    whole = [c for c in docs.columns]
    head = head.groupBy("__to").agg(F.min(F.struct("text", *(c for c in whole if c != "text"))).alias("r"))
    head = head.select(*(F.col("r")[c].alias(c) for c in whole), F.col("__to").alias("__run"), F.lit(True).alias("__copy"))
    w = Window.partitionBy("__run").orderBy("__copy", "doc_id", "text")
    ahead = add(dealt.unionByName(head)).select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return ahead.where(~F.col("__copy")).drop("__run", "__copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fingerprint (array<string>) and the band of the lexicon in idf_low, idf_high; a null text counts as empty."""
    tune(docs.sparkSession)
    bitmap, low, high = lexicon(docs)
    return docs.withColumn("fingerprint", fingerprint(F.col("text"), _literal(bitmap))).withColumns({"idf_low": F.lit(low), "idf_high": F.lit(high)})


def edits(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its text with the latter half exchanged for the next document's beginning, and likenesses.

    A null text counts as empty; rows that repeat a doc_id keep a row each, null ids come first; an empty table gives none.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bitmap, _, _ = lexicon(docs)
    lit = _literal(bitmap)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    printed = lambda df: df.withColumn("fp", fingerprint(F.col("text"), lit))
    ahead = with_next(docs, ["text", "fp"], printed).withColumn("n_chars", n.cast("long"))
    ahead = ahead.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    ahead = ahead.withColumn("edited_fp", fingerprint(F.col("edited"), lit))
    return ahead.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("fp", ":").alias("fingerprint"),
        F.array_join("edited_fp", ":").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
