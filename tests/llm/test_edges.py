"""Empty tables, clashing columns, repeated rows, null ids and very long texts."""

import base64

import public_tokenizers as P
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def test_bpe_edges(spark):
    import tiktoken

    from quern.llm.bpe import encoded

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["qwertyuiopasdfg" * 1500, "word " * 300_000, "same text", "same text", None]
    d = spark.createDataFrame([(1 if i == 3 else i or None, t) for i, t in enumerate(texts)], DOCS).withColumn("input_ids", F.lit("mine")).withColumn("n_tokens", F.lit(-1))
    got = encoded(d, path).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(true.encode_ordinary(t or "")) for t in texts)
    long = next(r for r in got if r.doc_id == 1 and r.n_tokens > 1000)
    assert list(long.input_ids) == true.encode_ordinary(texts[1])
    assert encoded(d.limit(0), path).count() == 0


def test_classifier_edges(spark):
    """No labels, one label only, null and repeated labels, columns that clash, long and empty texts."""
    from quern.llm import quality, toxicity

    texts = ["plain words here", "", None, "long text " * 50_000, "plain words here"]
    d = spark.createDataFrame([(i if i < 4 else None, t) for i, t in enumerate(texts)], DOCS).withColumn("quality_score", F.lit("mine")).withColumn("toxicity", F.lit("mine"))
    one = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, None), (3, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (one, one.limit(0)):
        t = toxicity.scored(d, toxicity.train(d, labels)).collect()
        assert len(t) == 5 and all(0 <= r.toxicity < 0.5 for r in t)
        q = quality.scored(d, quality.train(d, labels)).collect()
        assert len(q) == 5 and all(0 <= r.quality_score <= 1 for r in q)
    assert toxicity.scored(d.limit(0), toxicity.train(d, one)).count() == 0


def test_jaccard_edges(spark):
    from quern.llm.jaccard_join import jaccard_components

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(3, long), (5, long + " end"), (5, "a b c d"), (7, "A B  C D"), (None, "a b c d"), (None, "alone in here it is"), (8, ""), (8, None), (9, "x"), (9, "x")]
    d = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("mine"))
    got = sorted((tuple(r) for r in jaccard_components(d, 3, 90).collect()), key=repr)
    want = [(3, 29_998, 3), (5, 29_999, 3), (5, 2, 5), (7, 2, 5), (None, 2, 5), (None, 3, None), (8, 0, 8), (8, 0, 8), (9, 1, 9), (9, 1, 9)]
    assert got == sorted(want, key=repr)
    assert jaccard_components(d.limit(0), 3, 90).count() == 0


def test_html_edges(spark):
    from quern.llm.html_text import extracted

    page = "<article><h1>Title of it</h1><p>Some words of a text. They are here.</p></article>"
    rows = [(1, page), (1, page), (None, None), (2, ""), (3, "<p>" + "A long text goes on. " * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit("mine"))
    got = extracted(d).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 48), (1, 48), (2, 0), (3, 419_999)]
    assert extracted(d.limit(0)).count() == 0
