"""Bounds that keep op10, op9 and the pipeline from comparing unlike lines and sets, and joins whose sides must not go to the driver."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm import line_dedup as L


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _not_broadcast(plans):
    """Spark sizes a written table by its compressed files: some 250 kB became 21 MB in the driver."""
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that a job writes for itself."""
    out, made = [], common.Scratch.__init__
    monkeypatch.setattr(common.Scratch, "__init__", lambda self, df, what: (out.append(df._jdf.queryExecution().executedPlan().toString()), made(self, df, what))[1])
    return out


def test_sketches_bound_the_distance_from_below(spark):
    """Also with repeated words, inserted and deleted ones, and whatever sketch a line has."""
    r, rows = random.Random(5), []
    for _ in range(150):
        a = [f"w{r.randrange(r.choice((3, 30, 3000)))}" for _ in range(r.randrange(5, 130))]
        b = list(a)
        for _ in range(r.randrange(1, 2 + len(a) // 4)):
            at = r.randrange(len(b))
            b[at : at + r.randrange(2)] = [f"v{r.randrange(40)}"] * r.randrange(2)
        if b:
            rows.append((" ".join(a), " ".join(b), _edits(a, b)))
    pairs = spark.createDataFrame(rows, "x string, y string, d int")
    total = []
    for least in (L.WIDE, L.FINE):
        sides = [c.alias(i + name) for i, t in (("a", "x"), ("b", "y")) for c, name in zip(L._sketch(F.split(t, " "), least), L._SKETCH)]
        got = pairs.select("d", *sides).select("d", L._least().alias("least")).collect()
        assert all(x.least <= x.d for x in got)
        total.append(sum(x.least for x in got))
    assert 0.6 * sum(d for *_, d in rows) < total[0] < total[1]


def test_unlike_lines_around_a_passage_are_not_compared(spark, monkeypatch, plans):
    """Lines of some 80 words that share a passage of 60 stay below the similarity; only few of their pairs may leave the join."""
    r = random.Random(7)
    passage = [f"passage{i}" for i in range(60)]
    texts = [" ".join([f"a{r.randrange(900)}" for _ in range(r.randrange(2, 14))] + passage + [f"b{r.randrange(900)}" for _ in range(r.randrange(10, 16))]) for _ in range(60)]
    texts.append(texts[0] + " more")
    counts, join = [], L._unsettled
    monkeypatch.setattr(L, "_unsettled", lambda left: (counts.append(join(left).count()), join(left))[1])
    lines = spark.createDataFrame([(t,) for t in texts], "norm string").select(F.unhex(F.md5("norm")).alias("k"), F.size(F.split("norm", " ")).alias("n"), "norm")
    links = {tuple(sorted((bytes(x.u).hex(), bytes(x.v).hex()))) for x in L.similar_lines(lines).collect()}
    of = {x.norm: x.k.hex() for x in lines.select("norm", F.col("k").alias("k")).collect()}
    like = {tuple(sorted((of[s], of[t]))) for i, s in enumerate(texts) for t in texts[:i] if 5 * _edits(s.split(), t.split()) <= max(s.count(" "), t.count(" ")) + 1}
    assert links <= like and tuple(sorted((of[texts[0]], of[texts[-1]]))) in links
    assert counts[0] <= len(like) + 180  # of 1,830; by 128 parities alone nearly all
    _not_broadcast(plans)


def test_sets_that_share_too_few_parts_make_no_pairs(spark, monkeypatch, plans):
    """Sets with a passage in common share few parts each, and no pair of them is counted; near copies are."""
    from quern.llm import jaccard_join as J

    r = random.Random(4)
    word = lambda: f"w{r.randrange(1 << 40)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(150)] + passage + [word() for _ in range(150)]) for _ in range(40)]
    texts += [t.replace(t.split()[7], "other") for t in texts[:5]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    signed = d.mapInArrow(J._signed(5, 80), "doc_id long, h long, n_shingles long, key binary, signs array<bigint>, class int, need int, below int")
    found, pairs = [], J._pairs
    monkeypatch.setattr(J, "_pairs", lambda few: (found.extend(pairs(few).collect()), pairs(few))[1])
    clusters = J._clusters(signed)
    assert clusters.groupBy("region").count().agg(F.max("count"), F.count("*")).first() == (2, 5)
    assert len({(x.u, x.v) for x in found}) <= 45  # of 990
    _not_broadcast(plans)
