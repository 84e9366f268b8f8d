"""What both classifiers share: the held-out rule, a bounded sample of labelled documents, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; 0 marks held-out rows. A null id counts as its text being empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of about `most` labelled documents at most, none of them held out.

    The sample is by a hash of the id, so it is the same in every run; null labels are left out and
    of several labels for an id the largest holds. The ids sent to the documents are bounded by `most`.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    y = y.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = y.count()
    share = min(1.0, most / n) if n else 1.0
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
