"""Registered queries of the training-data operators, with the SQL that DuckDB can check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune
from .oracle import ORACLE_SQL  # noqa: F401


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    tune(spark)
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(sequence(1, size(hit_spans) div 2), 0L, (n, i) -> if(size(hit_spans) = 0, n, n + hit_spans[2 * i - 1] - hit_spans[2 * i - 2]))").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    n = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def _judged(scored: DataFrame, column: str, least: float) -> DataFrame:
    from .labelled import fold

    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col(column).alias("score"), (F.col(column) >= least).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(scored(docs, train(docs, table(spark, sf_dir, "labels"))), "quality_score", 0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(scored(docs, train(docs, table(spark, sf_dir, "labels"))), "toxicity", 0.5)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import edits

    return edits(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated

    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_imatch, op3_html_text, op4_quality, op5_byte_bpe, op6_warc, op7_toxicity, op8_token_counts, op9_jaccard_join, op10_line_dedup)}
