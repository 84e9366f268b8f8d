"""Clusters before the exact join: linked sets have as many parts in common as is asked of them; sets that share a few parts only are apart."""

import random

import numpy as np
import pytest


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("share", [80, 90])
def test_linked_sets_have_what_they_need(share):
    from quern.llm.jaccard_join import Pigeonholes

    rng, of, linked = np.random.default_rng(9), Pigeonholes(share), 0
    for _ in range(4000):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        gone = int(rng.integers(0, max(1, n * (100 - share) // 100) + 1))
        more = int(rng.integers(0, 1 + max(0, n * (100 - share) // 100 - gone)))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 64, more, np.uint64)]))
        c = len(np.intersect1d(a, b))
        if 100 * c < share * (len(a) + len(b) - c) or np.array_equal(a, b) or not len(b):
            continue
        linked += 1
        (x, (i, own, below)), (y, (j, own2, below2)) = of.signed(a), of.signed(b)
        need = max(own, own2) if i == j else max(own, below2) if i < j else max(below, own2)
        assert abs(i - j) <= 1 and len(np.intersect1d(x, y)) >= max(1, need)
    assert linked > 800


def test_a_passage_in_common_connects_nothing(spark):
    from pyspark.sql import functions as F

    from quern.llm.jaccard_join import _clusters, _signed, jaccard_components

    r = random.Random(4)
    word = lambda: f"w{r.randrange(1 << 40)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(150)] + passage + [word() for _ in range(150)]) for _ in range(40)]
    texts += [t.replace(t.split()[7], "other") for t in texts[:5]]
    d = docs(spark, texts)
    signed = d.withColumn("h", F.xxhash64("text")).mapInArrow(_signed(5, 80), "doc_id long, h long, n_shingles long, key binary, signs array<bigint>, class int, need int, below int")
    assert _clusters(signed).groupBy("region").count().agg(F.max("count"), F.count("*")).first() == (2, 5)
    got = {x.doc_id: x.component_id for x in jaccard_components(d, 5, 80).collect()}
    assert got == {k: k - 40 if k >= 40 else k for k in range(45)}


def test_near_copies_are_not_paired_with_each_other(spark, monkeypatch):
    """A group of near copies makes no pairs that grow with its square, also beside others of half its text; each group is one cluster."""
    from pyspark.sql import functions as F

    from quern.llm import jaccard_join as J

    r = random.Random(8)
    word = lambda: f"w{r.randrange(1 << 40)}"
    base = [word() for _ in range(300)]
    half = base[:150] + [word() for _ in range(150)]
    texts = [" ".join([*b[:k], word(), *b[k + 1 :]]) for b in (base, half) for k in range(0, 300, 3)]
    d = docs(spark, texts).withColumn("h", F.xxhash64("text"))
    signed = d.mapInArrow(J._signed(5, 80), "doc_id long, h long, n_shingles long, key binary, signs array<bigint>, class int, need int, below int")
    made, pairs = [], J._pairs
    monkeypatch.setattr(J, "_pairs", lambda few: (made.append(pairs(few).agg(F.sum("c")).first()[0] or 0), pairs(few))[1])
    assert sum(J._clusters(signed).groupBy("region").count().rdd.map(lambda x: x[1]).collect()) == 200
    assert sum(made) <= 200  # of some 200,000
    got = {x.doc_id: x.component_id for x in J.jaccard_components(d, 5, 80).collect()}
    assert got == {k: k - k % 100 for k in range(200)}


def test_blocks_in_passes(spark, monkeypatch):
    """A region that pivots can't cut is joined block against block, in any number of passes."""
    from quern.llm import jaccard_join as J

    monkeypatch.setattr(J, "REGION_SETS", 4)
    monkeypatch.setattr(J, "COPIES", 2)
    monkeypatch.setattr(J, "CUTS", 0)
    r = random.Random(6)
    base = [[r.getrandbits(63) for _ in range(40)] for _ in range(8)]
    sets = [np.array(sorted(b[:k] + b[k + 1 :]), np.uint64) for b in base for k in (0, 9)]
    rows = spark.createDataFrame([(b"one", i.to_bytes(16, "big"), 39, x.tobytes()) for i, x in enumerate(sets)], "region binary, key binary, n long, set binary")
    links = [x for t in J.join_regions(rows, 80) for x in t.collect()]
    assert {tuple(sorted(int.from_bytes(k, "big") for k in x)) for x in links} == {(2 * i, 2 * i + 1) for i in range(8)}
