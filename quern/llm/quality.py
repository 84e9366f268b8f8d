"""Quality by random Fourier features: a Gaussian kernel over document statistics, ridge scores, isotonic calibration.

Normal equations are summed per partition and added on the driver: their size is that of the
feature count squared, whatever the number of documents. Calibration is on training rows that the
ridge fit did not see.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import tune, written
from .labelled import training_rows

FEATURES, PARTS = 256, 16


def _classes() -> np.ndarray:
    """A class for each code point below U+3000: 0 other letter, 1 upper case, 2 digit, 3 space, 4 sentence mark, 5 symbol, 6 '!' or '?', 7 '|' or control."""
    out = np.full(0x3000, 5, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        if x.isalpha():
            out[c] = 1 if x.isupper() else 0
        elif x.isnumeric():
            out[c] = 2
        elif x.isspace():
            out[c] = 3
        elif x in ".,;:'\"-()":
            out[c] = 4
        elif x in "!?":
            out[c] = 6
        elif x == "|" or c < 32:
            out[c] = 7
    return out


_CLASS = _classes()
N_STATS = 19


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; a null or empty text gives zeros."""
    if not text:
        return [0.0] * N_STATS
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a)
    k = np.bincount(_CLASS[np.minimum(a, 0x2FFF)], minlength=8).tolist()
    words, lines = text.split(), text.split("\n")
    nw = len(words) or 1
    letters = k[0] + k[1] or 1
    length = [len(w) for w in words] or [0]
    size = np.array(length)
    distinct = len(set(words))
    return [
        np.log1p(n),
        np.log1p(nw),
        np.log1p(size.mean()),
        np.log1p(size.std()),
        k[1] / letters,
        k[2] / n,
        k[3] / n,
        k[4] / n,
        k[5] / n,
        k[6] / n,
        k[7] / n,
        letters / n,
        sum(map(eq, words, words[1:])) / nw,
        np.log1p(distinct) / np.log1p(nw),
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        float((size <= 3).mean()),
        text.count(".") / nw,
        float(np.count_nonzero(a > 127)) / n,
    ]


def _stats(batches, keep):
    for b in batches:
        own = [x for t in b.column("text").to_pylist() for x in statistics(t)]
        flat = pa.FixedSizeListArray.from_arrays(pa.array(own, pa.float64()), N_STATS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), flat], names=[*keep, "x"])


class Model:
    """Standardization, the random features, ridge weights, and the steps of the calibration."""

    def __init__(self, mean, scale, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1, (N_STATS, FEATURES)) / np.sqrt(N_STATS / 2)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta, self.knots, self.steps = np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.steps), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising fit of y over raw by pooling adjacent violators: (knots, values)."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first, last
    for r, v in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    knots = [x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    values = [x for b in blocks for x in [(b[0] + 0.5 * y.mean()) / (b[1] + 0.5)] * (2 if b[3] > b[2] else 1)]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 65_536, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Fits on about `most` labelled, not held-out documents at most; a quarter of them calibrates.

    Fewer than ten rows, or rows with one label only, give a constant score: the labels' mean, or a half without rows.
    """
    spark = tune(docs.sparkSession)
    rows = training_rows(docs, labels, label, most)
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0).select("y", "calibrates", "text")
    kept = written(rows.mapInArrow(lambda b: _stats(b, ["y", "calibrates"]), "y int, calibrates boolean, x array<double>"), "stats")
    sums = kept.agg(
        F.count("*").alias("n"), F.avg("y").alias("y"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)),
    ).first()
    mean = np.array([sums[f"m{i}"] or 0 for i in range(N_STATS)])
    scale = np.array([sums[f"s{i}"] or 0 for i in range(N_STATS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1), seed)
    if sums["n"] < 10 or sums["lo"] == sums["hi"]:
        model.steps = np.full(1, 0.5 if not sums["n"] else sums["y"])
        return model
    sent = spark.sparkContext.broadcast(model)

    def equations(batches):
        m, a, b, n = sent.value, np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for part in batches:
            x = np.array(part.column("x").to_pylist(), float).reshape(-1, N_STATS)
            z, y = m.features(x), part.column("y").to_numpy(zero_copy_only=False).astype(float)
            a += z.T @ z
            b += z.T @ y
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["a", "b", "n"])

    a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
    for r in kept.where("not calibrates").repartition(PARTS, F.xxhash64("x")).select("y", "x").mapInArrow(equations, "a binary, b binary, n long").toLocalIterator():
        a += np.frombuffer(r["a"]).reshape(a.shape)
        b += np.frombuffer(r["b"])
        n += r["n"]
    weight = np.full(FEATURES + 1, ridge * max(n, 1))
    weight[0] = 1e-9
    model.beta = np.linalg.solve(a + np.diag(weight), b)
    rest = kept.where("calibrates").select("y", "x").collect()
    if rest:
        model.knots, model.steps = isotonic(model.raw(np.array([r["x"] for r in rest])), np.array([r["y"] for r in rest], float))
    return model


def scored(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """docs with `column`: a score between 0 and 1. A null or empty text is scored by statistics of zero."""
    docs = docs.drop(column)
    keep = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(sent.value.score(x), pa.float64())], names=[*keep, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
