"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings of three to eight letters, which
catch inflected forms, each hashed to a slot. The machine has a weight and a short vector for each slot; the product of two
vectors scores two terms that stand in one document, which additive weights cannot.

Slots that enter are those whose link with the label is stronger than the best of as many chance
slots would be (a likelihood ratio against the number of slots), so that a few thousand rare words
of a long document do not drown a single insult; and of the PAIRED most frequent slots, those that have such a
link only together with another, beyond what the two have alone. Fitting is on the driver over a bounded sample;
scoring is a map over all documents.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import tune, written
from .labelled import training_rows

SLOTS = 1 << 22
FACTORS = 8
#: Documents of a step of the fit.
BATCH = 32
#: Log-likelihood by which a slot may stay below the best of all chance slots: beginnings of one word are far from independent.
SLACK = 2.5
#: Slots, the most frequent of the sample, whose pairs are tried.
PAIRED = 1024
#: Information on the label, in nats a document, that a pair must add: frequent pairs that shift it a little would be too many to fit.
SHIFT = 0.1
_WORD = re.compile(r"\w+")


def slots(text: str | None, known: dict[str, tuple[int, ...]]) -> set[int]:
    """The slots of a text's terms. known: the slots of words met before; it is emptied when it gets long."""
    out: set[int] = set()
    if not text:
        return out
    for w in set(_WORD.findall(text.lower())):
        found = known.get(w)
        if found is None:
            terms = [w, *("^" + w[:k] for k in range(3, 9) if len(w) >= k)]
            found = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in terms)
            if len(w) < 64:
                if len(known) > 1 << 18:
                    known.clear()
                known[w] = found
        out.update(found)
    return out


def _counts(batches):
    """(slot, n, k) of a partition: its documents with the slot, and those of them with label 1."""
    known: dict = {}
    n, k = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            own = np.fromiter(slots(t, known), np.int64)
            n[own] += 1
            k[own] += y
    at = np.flatnonzero(n)
    for s in range(0, len(at), 1 << 16):
        part = at[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part].astype(np.int64)), pa.array(k[part].astype(np.int64))], names=["slot", "n", "k"])


def _sets(used: frozenset[int]):
    def run(batches):
        known: dict = {}
        for b in batches:
            own = [np.array(sorted(slots(t, known) & used), np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(own, pa.binary())], names=["y", "slots"])

    return run


class Machine:
    """A fitted factorization machine: bias, and a weight and a vector for each slot in use."""

    def __init__(self, used: list[int], bias: float, weight: np.ndarray, vector: np.ndarray):
        self.at = {int(s): k for k, s in enumerate(used)}
        self.bias, self.weight, self.vector = bias, weight, vector

    def score(self, own: list[int]) -> float:
        v = self.vector[own]
        total = v.sum(0)
        z = self.bias + self.weight[own].sum() + 0.5 * (total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def choose(counts: DataFrame, n: int, positive: int) -> tuple[list[int], list[int]]:
    """(slots of at least two documents whose likelihood ratio exceeds what as many chance slots would give, the PAIRED most frequent slots).

    The number of the former is bounded: each takes at least ln 2 of the sample's likelihood of n documents, times the terms of one.
    """
    p = min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
    some = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n >= 2")
    part = lambda a, share: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / (F.col("n") * share))).otherwise(0.0)
    some = written(some.withColumn("rest", F.col("n") - F.col("k")).withColumn("gain", part("k", p) + part("rest", 1 - p)), "slots")
    most = some.count()
    own = some.where(F.col("gain") > float(np.log(max(2, most))) - SLACK).select("slot")
    frequent = some.orderBy(F.desc("n"), "slot").limit(PAIRED).select("slot")
    return sorted(r["slot"] for r in own.collect()), sorted(r["slot"] for r in frequent.collect())


def paired(frequent: list[int], sets: list[np.ndarray], y: np.ndarray) -> list[int]:
    """Those of the frequent slots that shift the label in a pair, against what either slot and both, taken as independent, lead to expect."""
    at = {s: k for k, s in enumerate(frequent)}
    m = len(frequent)
    n, k = np.zeros((m, m)), np.zeros((m, m))
    for s in range(0, len(sets), 1024):
        x = np.zeros((len(sets[s : s + 1024]), m), np.float32)
        for r, own in enumerate(sets[s : s + 1024]):
            x[r, [at[v] for v in own.tolist() if v in at]] = 1
        n += x.T @ x
        k += x.T @ (x * y[s : s + 1024, None].astype(np.float32))
    share = lambda a, b: np.clip(a / np.maximum(b, 1), 1e-3, 1 - 1e-3)
    logit = lambda p: np.log(p / (1 - p))
    alone = share(np.diag(k), np.diag(n))
    both = logit(alone)[:, None] + logit(alone)[None, :] - logit(share(y.sum(), len(y)))
    found = share(k, n)
    gain = lambda p: k * np.log(found / p) + (n - k) * np.log((1 - found) / (1 - p))
    least = np.minimum(np.minimum(gain(alone[:, None]), gain(alone[None, :])), gain(1 / (1 + np.exp(-both))))
    np.fill_diagonal(least, 0)
    strong = (least > np.log(max(2, m * m / 2))) & (least > SHIFT * n)
    return [frequent[i] for i in np.flatnonzero(strong.any(1))]


def fit(used: list[int], sets: list[np.ndarray], y: np.ndarray, epochs: int = 40, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over shuffled documents, some at a time. Without both labels: a constant score near their mean; without any label, 0.25."""
    rng = np.random.default_rng(seed)
    p = (y.sum() + 0.5) / (len(y) + 2)
    w, v, b = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), FACTORS)), float(np.log(p / (1 - p)))
    if not len(used):
        return Machine(used, b, w, v)
    at = {int(s): k for k, s in enumerate(used)}
    rows = [np.array([at[s] for s in x.tolist() if s in at], np.int64) for x in sets]
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    empty = np.array([not len(r) for r in rows])
    some, n0, y0 = np.flatnonzero(~empty), empty.sum(), y[empty].sum()
    size = np.array([len(r) for r in rows])
    start, flat = np.cumsum(size) - size, np.concatenate(rows)
    for _ in range(epochs):
        by = rng.permutation(some)
        for s in range(0, len(by), BATCH):
            own = by[s : s + BATCH]
            x = np.zeros((len(own), len(w)))
            at_row = np.repeat(np.arange(len(own)), size[own])
            x[at_row, flat[np.arange(len(at_row)) + np.repeat(start[own] - (np.cumsum(size[own]) - size[own]), size[own])]] = 1
            total = x @ v
            z = b + x @ w + 0.5 * ((total * total).sum(1) - x @ (v * v).sum(1))
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]
            n, sums = x.sum(0), x.T @ d
            g = sums + 1e-4 * n * w
            gw += g * g
            w -= 0.3 * g / np.sqrt(gw)
            h = x.T @ (d[:, None] * total) - sums[:, None] * v + 1e-3 * n[:, None] * v
            gv += h * h
            v -= 0.05 * h / np.sqrt(gv)
            gb += d.sum() ** 2
            b -= 0.3 * d.sum() / np.sqrt(gb)
        if n0:  # documents without any slot in use differ only in their label
            d = n0 / (1 + np.exp(-b)) - y0
            gb += d * d
            b -= 0.3 * d / np.sqrt(gb)
    return Machine(used, b, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 16_384) -> Machine:
    """Fits on about `most` labelled, not held-out documents at most."""
    tune(docs.sparkSession)
    sample = written(training_rows(docs, labels, label, most).select("text", "y"), "sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    used, frequent = choose(sample.mapInArrow(_counts, "slot long, n long, k long"), n, positive)
    rows = sample.mapInArrow(_sets(frozenset(used) | frozenset(frequent)), "y int, slots binary").collect()
    rows.sort(key=lambda r: (bytes(r["slots"]), r["y"]))
    sets, y = [np.frombuffer(r["slots"], np.int32) for r in rows], np.array([r["y"] for r in rows], float)
    used = sorted({*used, *paired(frequent, sets, y)}) if 0 < y.sum() < len(y) else used
    return fit(used, sets, y)


def scored(docs: DataFrame, machine: Machine, column: str = "toxicity") -> DataFrame:
    """docs with `column`: a score between 0 and 1. A null or empty text gets the score of no terms."""
    docs = docs.drop(column)
    keep = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m, known = sent.value, {}
        for b in batches:
            own = [m.score(sorted(m.at[s] for s in slots(t, known) & m.at.keys())) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(own, pa.float64())], names=[*keep, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with the columns of docs, whatever their names."""
    return scored(docs, machine, "__toxicity").where(F.col("__toxicity") < threshold).select(docs.columns)
