"""Rows that repeat, clash or lack ids, in the operators on documents and pages, and in the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], DOCS)


def test_one_of_each_by_row(spark):
    """Rows go, not ids: another text under the id of a copy stays, rows that repeat are copies."""
    from quern.llm.jaccard_join import one_of_each

    a, unique, other = "one two three four five six seven", "quite another text of some seven words", "and a third one that is like none"
    free = "one text without id that is like no other"
    rows = [(0, a), (0, a), (2, a), (2, unique), (4, other), (5, ""), (6, None), (None, a), (None, free)]
    d = spark.createDataFrame(rows, DOCS).withColumn("n_shingles", F.lit("mine"))
    got = sorted(map(tuple, one_of_each(d).collect()), key=repr)
    want = [(0, a), (2, unique), (4, other), (5, ""), (6, None), (None, free)]
    assert got == sorted([(*x, "mine") for x in want], key=repr)
    assert one_of_each(d.limit(0)).count() == 0


def test_warc_with_repeated_page_ids(spark):
    from quern.llm.common import scratch_path
    from quern.llm.warc import read_archives, write_archives

    rows = [(5, "A"), (5, "B"), (6, "A"), (7, "B"), (9, "D"), (9, "E"), (10, "D"), (None, "D")]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string")
    path = scratch_path(spark, "test")
    write_archives(pages, path)
    digest = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for _, t in rows}
    got = sorted(((r.page_id, digest[r.payload_digest], r.record_type, r.refers_to) for r in read_archives(spark, path).collect()), key=repr)
    first = {"A": 6, "B": 7, "D": 10}
    want = [(i, t, "response", None) if i is None or first.get(t, i) == i else (i, t, "revisit", first[t]) for i, t in rows]
    assert got == sorted(want, key=repr)
    empty = scratch_path(spark, "test")
    write_archives(pages.limit(0), empty)
    assert read_archives(spark, empty).count() == 0


def test_deep_pages_take_linear_time():
    import time

    from quern.llm.html_text import default_model

    model, start = default_model(), time.time()
    assert model.text("<ul>" * 200_000 + "<p>Some words of a text. They are deep.") is not None
    assert time.time() - start < 30


def test_marginals_equal_enumeration():
    """Sum-product messages against the sum over all states of small trees."""
    import itertools
    import math

    from quern.llm.html_text import CONTENT, default_model, order, parse

    m = default_model()
    for page in ("<div><p>One two. Three.</p><nav><a href='/'>x</a></nav></div>", "<article><h1>T</h1><p>Some text, here.</p></article>", "plain text only"):
        nodes = order(parse(page))
        assert len(nodes) <= 9
        at = {id(x): k for k, x in enumerate(nodes)}
        pot = [m.potentials(x) for x in nodes]
        total, own = 0.0, {id(x): 0.0 for x in nodes if x.tag == "#"}
        for state in itertools.product(range(3), repeat=len(nodes)):
            w = math.log((1e-6, 1e-6, 1.0)[state[0]]) + pot[0][state[0]]
            for k, x in enumerate(nodes[1:], 1):
                w += pot[k][state[k]] + m.pair[state[at[id(x.parent)]]][state[k]]
            w = math.exp(w)
            total += w
            for x in nodes:
                if x.tag == "#" and state[at[id(x)]] == CONTENT:
                    own[id(x)] += w
        got = m.marginals(nodes)
        for k, v in own.items():
            assert got[k] == pytest.approx(v / total, abs=1e-6)


def _labels(spark, y):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")


def test_interactions_without_a_link_of_their_own(spark):
    """Toxic if exactly one of two words stands in the text: neither word alone tells anything."""
    from quern.llm.toxicity import scored, train

    rng = np.random.default_rng(1)
    a, b = rng.random(600) < 0.5, rng.random(600) < 0.5
    texts = [" ".join(["filler%d" % rng.integers(0, 30) for _ in range(6)] + ["qqalpha"] * int(x) + ["zzbeta"] * int(y)) for x, y in zip(a, b)]
    d = docs(spark, texts)
    got = {r.doc_id: r.toxicity for r in scored(d, train(d, _labels(spark, a ^ b))).collect()}
    assert np.mean([(got[i] >= 0.5) == (a[i] != b[i]) for i in range(600)]) >= 0.95


def test_without_labels_nothing_is_rejected(spark):
    from quern.llm.toxicity import train, without_toxic

    d = docs(spark, ["one", "two", None]).withColumn("toxicity", F.lit("mine"))
    none = _labels(spark, [0]).limit(0)
    assert sorted(map(tuple, without_toxic(d, train(d, none)).collect()), key=repr) == [(0, "one", "mine"), (1, "two", "mine"), (2, None, "mine")]


def test_decontaminated_keeps_columns(spark):
    from quern.llm.decontaminate import decontaminated

    d = docs(spark, ["a b c", "tiny item", "tiny item"]).withColumn("n_words", F.lit("mine")).withColumn("hit_items", F.lit(7))
    bench = spark.createDataFrame([(1, "tiny item")], "item_id long, text string")
    assert [tuple(r) for r in decontaminated(d, bench).collect()] == [(0, "a b c", "mine", 7)]
    assert decontaminated(d, bench.limit(0)).count() == 3


def test_token_counts_of_rows(spark, monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from quern.llm import token_counts as T

    path = P.path("byte_bpe_50k.json")
    true = Tokenizer.from_file(path)
    rows = [(1, "uncommonwordishness again"), (1, "uncommonwordishness again"), (None, "xqzzy " * 3000), (2, None), (3, "一つ二つ" * 50)] + [(i, f"piece{i} qwertzuiop") for i in range(4, 40)]
    monkeypatch.setattr(T, "CHUNK_DOCS", 8)
    d = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = sorted((tuple(r) for r in T.token_counts(d, path).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(true.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert T.token_counts(d.limit(0), path).count() == 0


def test_pipeline(spark, tmp_path):
    """All stages over rows with nulls, repeats, clashing columns and an empty labels table."""
    import corpus_pipeline

    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    body = ["the first document tells of %s and of nothing else in the world %d" % (w, i) for i, w in enumerate(("ships", "trees", "stones"))]
    text = "\n".join(body)
    rows = [(1, text), (2, text), (2, "a document of its own with some words"), (3, "leaked " + bench + " text"), (4, None), (5, ""), (6, "short"), (6, "short")]
    d = spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long"))
    d.withColumn("n_words", F.lit("x")).withColumn("toxicity", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 4, 5, 6]
    assert all(r.n_tokens > 0 for r in out if r.doc_id in (1, 2, 6))


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_warc", "op9_jaccard_join"])
def test_matches_duckdb(spark, name):
    import os

    import duckdb
    import pandas as pd

    from quern.llm.queries import ORACLE_SQL, QUERIES

    folder, c = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    got, want = QUERIES[name](spark, folder).toPandas(), c.sql(ORACLE_SQL[name]).df()
    plain = lambda df: sorted((tuple(None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(want.columns)].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)
