"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance is a metric, but sets of unrelated documents all lie near distance 1 from any pivot
and from each other, so windows around pivots alone prune nothing among them. Before pivots are
drawn, space is therefore cut by pigeonholes: shingles are dealt to so many parts by their hash that
linked sets, which differ in few shingles, must have at least one part in common that is not empty, and mostly
many. Two sets that meet in small groups of equal parts only are connected if they have as many in common as a
linked pair must; all sets of a larger group are connected. Clusters are what is connected so; no link leaves a cluster.

A cluster that fits a task is joined there. A larger one is cut by pivots: a set goes to the region
of its nearest pivot, or, beyond RADIUS from all, to one outer region; and to each other region that
the triangle inequality allows a linked set to be in. In a region, sets that the pivot links already
are one component; they stay only while an unlinked set is within the threshold of their distance to
the pivot. Regions that are still too large are cut again; what pivots can't cut is joined block
against block. Only links of a spanning forest leave a task.

Equal sets are one node. Shingles are 64-bit hashes; within a pair of documents they stand for the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected, even, tune, written

#: Sets, and shingles in them, that one task joins at once; pivots of a cut; cuts before blocks.
REGION_SETS, REGION_SHINGLES, PIVOTS, CUTS = 512, 1 << 21, 8, 4
#: Parts in which signatures are looked for repeats, one after another; sets up to which those of a signature are counted pair by pair.
PARTS, PAIRED = 6, 256
#: Pairs for each row from which near copies are put together before sets are paired.
CROWDED = 8
#: Share from which parts in common aren't counted: linked sets are cut into fewer, longer parts, which unlike sets rarely share.
COUNTED_BELOW = 90
#: Copies of a set that are on disk at once when blocks are joined.
COPIES = 8
#: Distance up to which a set belongs to its nearest pivot; growth in rows from which a cut is given up for blocks.
RADIUS, GROWTH = 0.5, 1.5
#: More regions, or more bytes of pivots, than this are told apart by a shuffle instead of being sent to every executor.
SEND_REGIONS, SEND_BYTES = 10_000, 32 << 20
_EDGE = "u binary, v binary"


class _Words(dict):
    """64-bit hashes of words, made as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Word n-gram hashes of texts; remembers the hashes of words."""

    def __init__(self, n: int):
        self.n, self.known = n, _Words()
        self.factor = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(n + 1)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, ascending; a text with fewer words is one shingle, one without words none."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 1 << 20:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (h[i : len(h) - k + 1 + i] * self.factor[i])) * self.factor[k]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def set_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class Pigeonholes:
    """Signatures of shingle sets: linked sets, if they differ, have one in common.

    Sizes fall into classes a factor of 100 / share apart, so that linked sets are in the same or in
    adjacent classes; each set signs for its own class and the one below. In a class, linked sets differ
    in at most `most` shingles, hence in as many parts. With most + 1 + spare parts they agree on more than
    `spare`, and so on one that isn't empty, unless both have more than `spare` empty parts, which is
    a signature of its own (rare: spare is some deviations above the expected number).
    """

    def __init__(self, share: int):
        self.t, self.parts = share / 100, {}

    def layout(self, c: int) -> tuple[int, int]:
        """(parts, spare) of a class."""
        if c not in self.parts:
            least = max(1.0, (1 / self.t) ** c)
            most = int((1 - self.t) / self.t * int(least / self.t * (1 + 1e-6)) + 1e-9)
            spare = 0
            for _ in range(3 if most else 0):
                m = most + 1 + spare
                mean = m * (1 - 1 / m) ** least
                spare = int(mean + 5 * np.sqrt(mean) + 1)
            self.parts[c] = (most + 1 + spare, spare)
        return self.parts[c]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return self.signed(s)[0]

    def signed(self, s: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
        """Signatures of ascending distinct 64-bit hashes, none if only equal sets link; and (class, need, need_below).

        Linked sets agree on more than `spare` parts of the layout for the smaller one's class, so on need = spare + 1 less
        those that are empty in both: the larger need of the two sets is what they have in common at least (or 1, the signature of empty parts).
        """
        if not len(s):
            return np.zeros(0, np.uint64), (0, 1, 1)
        own = int(np.log(len(s)) / np.log(1 / self.t) + 1e-9) if self.t < 1 else 0
        need = {}
        mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        out = []
        for c in {own, max(0, own - 1)}:
            m, spare = self.layout(c)
            need[c] = 1
            if m == 1:
                continue
            part = np.arange(m, dtype=np.uint64)
            at = np.searchsorted(s, part * np.uint64((1 << 64) // m))
            full = np.diff(np.append(at, len(s))) > 0
            x = np.add.reduceat(mixed, at[full]) ^ ((part[full] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            need[c] = int(spare + 1 - (m - full.sum()))
            if m - full.sum() > spare:
                x = np.append(x, np.uint64(0))
            x = (x + np.uint64(c + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append(x ^ (x >> np.uint64(32)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64), (own, need[own], need[max(0, own - 1)])


def _signed(n: int, share: int):
    """(doc_id, h, n_shingles, key, signs, class, need, below)"""

    def run(batches):
        shingle, signs_of = Shingler(n), Pigeonholes(share)
        for b in batches:
            sizes, keys, signs, needs = [], [], [], []
            for t in b.column("text"):
                s = shingle(t.as_py())
                sizes.append(len(s))
                keys.append(set_key(s.tobytes()) if len(s) else None)
                found, need = signs_of.signed(s)
                signs.append(found.view(np.int64))
                needs.append(need)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64())), *(pa.array([x[i] for x in needs], pa.int32()) for i in range(3))],
                names=["doc_id", "h", "n_shingles", "key", "signs", "class", "need", "below"],
            )

    return run


def components(sets: list[np.ndarray], share: int) -> np.ndarray:
    """For sets of one region: the index of the first set that each is linked with, directly or through others."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(m)
    if m < 2:
        return root
    owner = np.repeat(np.arange(m), size)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[column] > 1
    owner, column = owner[keep], column[keep]
    common = np.zeros((m, m), np.float32)
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    count = np.diff(np.append(starts, len(column)))
    for k in np.unique(count):  # rare shingles: their few pairs; frequent ones: a matrix product
        if k > 24:
            break
        rows = owner[starts[count == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        for s in range(0, len(rows), max(1, (1 << 20) // len(i))):
            part = rows[s : s + max(1, (1 << 20) // len(i))]
            common += np.bincount((part[:, i] * m + part[:, j]).ravel(), minlength=m * m).reshape(m, m).astype(np.float32)
    common += common.T
    often = np.repeat(count > 24, count)
    if often.any():
        own, col = owner[often], np.unique(column[often], return_inverse=True)[1]
        for s in range(0, int(col.max()) + 1, 2048):
            here = (col >= s) & (col < s + 2048)
            a = np.zeros((m, 2048), np.float32)
            a[own[here], col[here] - s] = 1
            common += a @ a.T
    c = np.rint(common).astype(np.int64)
    linked = 100 * c >= share * (size[:, None] + size[None, :] - c)
    seen = np.zeros(m, bool)
    for i in range(m):
        if not seen[i]:
            front = np.array([i])
            seen[i] = True
            while len(front):
                root[front] = i
                front = np.flatnonzero(linked[front].any(0) & ~seen)
                seen[front] = True
    return root


def _distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(shared, union) of two ascending arrays of distinct values."""
    x = np.concatenate([a, b])
    x.sort()
    c = int((x[1:] == x[:-1]).sum())
    return c, len(a) + len(b) - c


def _joined(share: int):
    """Links of a spanning forest for each region; rows come sorted by region."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def finish():
            if len(keys) > 1:
                pairs = [(keys[i], keys[r]) for i, r in enumerate(components(sets, share).tolist()) if i != r]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs)], names=["u", "v"])

        for b in batches:
            for region, key, raw in zip(b.column("region").to_pylist(), b.column("key").to_pylist(), b.column("set").to_pylist()):
                if region != now:
                    yield from finish()
                    now, keys, sets, seen = region, [], [], set()
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(np.frombuffer(raw, np.uint64))
        yield from finish()

    return run


_CUT = "parent binary, region binary, key binary, n long, set binary, d double, linked boolean, pivot binary"


def _cut(share: int, pivots=None):
    """Rows of large clusters -> a row for each region they are in. pivots: region -> [(key, set)], sent, or None where rows carry them."""
    eps = 1 - share / 100

    def run(batches):
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                s, home = np.frombuffer(r["set"], np.uint64), r["region"]
                own = [(p["key"], p["set"]) for p in r["pivots"]] if pivots is None else pivots.value[home]
                found = [_distance(s, np.frombuffer(p, np.uint64)) for _, p in own]
                d = [1 - c / u for c, u in found]
                best = min(d)
                if best > RADIUS:
                    rows.append((home, home + b"outer.", r["key"], r["n"], r["set"], 2.0, False, b""))
                for (p, _), x, (c, u) in zip(own, d, found):
                    if x <= min(best + 2 * eps, RADIUS + eps) + 1e-9:
                        rows.append((home, home + p[:6], r["key"], r["n"], r["set"], x, 100 * c >= share * u, p))
            if rows:
                kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.float64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["parent", "region", "key", "n", "set", "d", "linked", "pivot"])

    return run


def join_regions(rows: DataFrame, share: int) -> list[DataFrame]:
    """Links (u, v) among rows (region, key, n, set) within regions, exactly; regions may have any size."""
    out, whole = [], []
    spark = rows.sparkSession
    for level in range(CUTS + 1):
        size = written(rows.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")), "regions")
        large = (F.col("sets") > REGION_SETS) | (F.col("shingles") > REGION_SHINGLES)
        large = size.where(large & (F.col("sets") > 1))
        n_large = large.count()
        names = F.broadcast(large) if n_large <= SEND_REGIONS else even(large)
        small = rows.join(names.select("region"), "region", "left_anti") if n_large else rows
        out.append(written(small.select("region", "key", "set").repartition("region").sortWithinPartitions("region").mapInArrow(_joined(share), _EDGE), "links"))
        if not n_large:
            break
        rows = rows.join(names.select("region", "sets", "shingles"), "region")
        if level == CUTS:
            whole.append(rows)
            break
        share_of = rows.where(F.pmod(F.xxhash64("key", F.lit(level)), F.col("sets")) < 4 * PIVOTS).withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("key", F.lit(level + 100)), "key")))
        drawn = written(share_of.where(F.col("rank") <= PIVOTS).select("region", "key", "set"), "pivots")
        pivots = drawn.groupBy("region").agg(F.collect_list(F.struct("key", "set")).alias("pivots"))
        mine = rows.join(F.broadcast(drawn.select("region").distinct()) if n_large <= SEND_REGIONS else drawn.select("region").distinct(), "region", "left_semi").select("region", "key", "n", "set")
        if (drawn.agg(F.sum(F.octet_length("set") + 100)).first()[0] or 0) <= SEND_BYTES:
            at: dict = {}
            for r in drawn.toLocalIterator():
                at.setdefault(bytes(r["region"]), []).append((bytes(r["key"]), bytes(r["set"])))
            cut = mine.mapInArrow(_cut(share, spark.sparkContext.broadcast(at)), _CUT)
        else:
            cut = mine.join(even(pivots), "region").mapInArrow(_cut(share), _CUT)
        held = Scratch(cut, "cut")
        cut = held.df
        out.append(written(cut.where("linked and key <> pivot").select(F.col("key").alias("u"), F.col("pivot").alias("v")), "links"))
        far = cut.where("not linked").groupBy("region").agg(F.min("d").alias("far"))
        rest = cut.join(even(far), "region").where((~F.col("linked")) | (F.col("d") >= F.col("far") - (1 - share / 100) - 1e-9)).where("key <> pivot")
        grown = written(rest.groupBy(F.col("parent").alias("region")).agg(F.count("*").alias("after")).join(large, "region").where(F.col("after") > GROWTH * F.col("sets")).select("region"), "grown")
        whole.append(rows.join(even(grown), "region", "left_semi"))
        lost = rows.join(drawn.select("region").distinct(), "region", "left_anti").select("region", "key", "n", "set")
        rest = rest.join(grown.withColumnRenamed("region", "parent"), "parent", "left_anti")
        rows = written(rest.select("region", "key", "n", "set").unionByName(lost), "rest")
        held.drop()
    if not whole:
        return out
    rows = _all([x.select("region", "key", "n", "set", "sets", "shingles") for x in whole])
    # block against block: each set meets each other one in some pair of blocks; pairs of blocks are joined in several passes
    blocks = F.greatest(F.ceil(F.col("sets") / (REGION_SETS // 2)), F.ceil(F.col("shingles") / (REGION_SHINGLES // 2))).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(991)), F.col("blocks")).cast("int")
    held = Scratch(rows.select("region", "key", "set", blocks.alias("blocks")), "blocks")
    passes = -(-(held.df.agg(F.max("blocks")).first()[0] or 1) // COPIES)
    for k in range(passes):
        pair = held.df.withColumn("own", own).withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.pmod(x + F.col("own"), F.lit(passes)) == k)))
        pair = pair.select(F.concat("region", F.encode(F.concat_ws(".", F.lit(""), F.least("own", "other"), F.greatest("own", "other")), "utf-8")).alias("region"), "key", "set")
        out.append(written(pair.repartition("region").sortWithinPartitions("region").mapInArrow(_joined(share), _EDGE), "links"))
    held.drop()
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionAll(x)
    return out


def _able(few: DataFrame, some: DataFrame) -> DataFrame:
    """(id) of sets with as many signatures in few (t, id) as one of a linked pair has in common at least."""
    least = some.groupBy("id").agg(F.min(F.least("need", "below")).alias("least"))
    return few.groupBy("id").agg(F.count("*").alias("c")).join(even(least), "id").where("c >= least").select("id")


def _pairs(few: DataFrame) -> DataFrame:
    """(u, v, c): sets of few (t, id) that have c signatures in common."""
    groups = few.groupBy("t").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    after = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("u"), y.alias("v")))
    return groups.select(F.explode(F.flatten(F.transform("ids", after))).alias("p")).groupBy("p.u", "p.v").agg(F.count("*").alias("c"))


def _starred(few: DataFrame) -> DataFrame:
    """(u, v, c): sets of few (t, id) and the least set v of a signature, which have c such signatures in common."""
    least = few.groupBy("t").agg(F.min("id").alias("v"))
    return few.join(even(least), "t").where("id <> v").groupBy(F.col("id").alias("u"), "v").agg(F.count("*").alias("c"))


def _pruned(few: DataFrame, least: DataFrame) -> DataFrame:
    """few (t, id) without signatures of one set, and then without sets that have fewer than they need; least: (id, least)."""
    shared = few.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("t")
    few = few.join(even(shared), "t")
    own = few.groupBy("id").agg(F.count("*").alias("c")).join(even(least.select("id", "least")), "id").where("c >= least").select("id")
    return few.join(even(own), "id").select("t", "id")


def _able_pairs(few: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, c): sets of few (t, id) that have c signatures in common, all pairs with as many as one of them needs at least.

    Of sets that need n in common, one is not among the n - 1 most frequent signatures of either: pairs are made of the others, and counted by all.
    """
    often = few.groupBy("t").agg(F.count("*").alias("k"))
    lists = few.join(even(often), "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("ts")).join(even(least.select("id", "least")), "id")
    lists = written(lists.where(F.size("ts") >= F.col("least")).select("id", "least", F.col("ts.t").alias("ts")), "lists")
    rare = lists.select("id", F.explode(F.slice("ts", F.lit(1), F.size("ts") - F.greatest("least", F.lit(1)) + 1)).alias("t"))
    pairs = _pairs(rare.select("t", "id")).select("u", "v")
    for i in "uv":
        pairs = pairs.join(even(lists.select(F.col("id").alias(i), F.col("ts").alias(i + "ts"))), i)
    return pairs.select("u", "v", F.size(F.array_intersect("uts", "vts")).alias("c"))


def _enough(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """(u, v) of pairs (u, v, c) with a c that linked sets have at least. each: (id, class, need, below, least); class is null for several sets, of which each two need `least`."""
    for i in "uv":
        pairs = pairs.join(even(each.select(F.col("id").alias(i), *(F.col(c).alias(i + c) for c in ("class", "need", "below", "least")))), i)
    need = F.when(F.col("uclass") == F.col("vclass"), F.greatest("uneed", "vneed")).when(F.col("uclass") < F.col("vclass"), F.greatest("uneed", "vbelow")).when(F.col("uclass") > F.col("vclass"), F.greatest("ubelow", "vneed"))
    return pairs.where(F.col("c") >= F.coalesce(need, F.greatest("uleast", "vleast"))).select("u", "v")


def _clusters(signed: DataFrame, counted: bool = True) -> DataFrame:
    """(id, region): sets, by the hash of their key, that signatures connect with others; region is the least of a cluster.

    Signatures are looked for repeats in parts, so that only a part of them is on disk at once. Those of more than PAIRED sets
    connect all of them. Two sets that have only others in common must have as many as linked sets have at least, so that a set
    that shares fewer, with whatever sets, is in no pair; that takes more steps, and without counted any one in common connects.
    Near copies, which share most signatures with the least of them, are connected with that one first and stand as one set among
    the pairs, so that these don't grow with the square of their number; two such groups need what any two of their sets need.
    """
    some = signed.where(F.size("signs") > 0).select(F.xxhash64("key").alias("id"), "signs", "class", "need", "below")
    found, held = None, []
    for part in range(PARTS):
        rows = some.select("id", F.explode(F.filter("signs", lambda x: F.pmod(x, F.lit(PARTS)) == part)).alias("t"))
        shared = Scratch(rows.groupBy("t").agg(F.min("id").alias("v"), F.max("id").alias("hi")).where("v < hi").select("t", "v"), "shared")
        if not counted:
            met = written(rows.join(even(shared.df), "t").where("id <> v").select(F.col("id").alias("u"), "v").distinct(), "members")
            shared.drop()
            found = met if found is None else found.unionAll(met)
            continue
        both = Scratch(rows.join(even(shared.df), "t").select("t", "id", "v").distinct(), "held")
        many = both.df.groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") > PAIRED).select("t")
        star = written(both.df.join(even(many), "t").where("id <> v").select(F.col("id").alias("u"), "v").distinct(), "met")
        held.append(Scratch(both.df.join(even(many), "t", "left_anti").select("t", "id"), "few"))
        shared.drop()
        both.drop()
        found = star if found is None else found.unionAll(star)
    if not counted:
        return connected(found).select(F.col("node").alias("id"), F.col("root").alias("region"))
    few = _all([x.df for x in held])
    able = _able(few, some)
    few = written(few.join(even(able), "id").select("t", "id"), "able")
    for x in held:
        x.drop()
    each = some.join(even(few.select("id").distinct()), "id").groupBy("id").agg(*(F.first(c).alias(c) for c in ("class", "need", "below")))
    each = written(each.withColumn("least", F.least("need", "below")), "each")
    few = written(_pruned(few, each), "able")
    k = F.col("k")
    crowd = few.groupBy("t").agg(F.count("*").alias("k")).agg(F.sum(k * (k - 1) / 2).alias("pairs"), F.sum("k").alias("rows")).first()
    if (crowd["pairs"] or 0) > CROWDED * (crowd["rows"] or 0):
        close = written(_enough(_starred(few), each), "close")
        found = found.unionAll(close)
        root = written(connected(close).select(F.col("node").alias("id"), "root"), "near")
        first, one = F.coalesce("root", "id"), F.count("*") == 1
        each = each.join(even(root), "id", "left").groupBy(first.alias("id")).agg(*(F.when(one, F.first(c)).alias(c) for c in ("class", "need", "below")), F.min("least").alias("least"))
        each = written(each, "each")
        few = written(_pruned(few.join(even(root), "id", "left").select("t", first.alias("id")).distinct(), each), "able")
    edges = written(found.unionAll(_enough(_able_pairs(few, each), each)), "members")
    return connected(edges).select(F.col("node").alias("id"), F.col("root").alias("region"))


def _bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Which of 2 ** k values h takes, k chosen for n hashes: at most 32 MB, put together by executors; a filter, false only for what is certainly not there."""
    size = 1 << min(28, max(20, (8 * n).bit_length()))
    at = F.pmod("h", F.lit(size)) + 1
    part = hashes.groupBy(F.call_function("bitmap_bucket_number", at).alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", at)).alias("m"))
    bits = np.zeros(size // 8, np.uint8)
    for r in part.toLocalIterator():
        raw = np.frombuffer(bytes(r["m"]), np.uint8)
        first = (r["b"] - 1) * 4096
        bits[first : first + 4096] = raw[: len(bits) - first]
    return bits


def _grouped(docs: DataFrame, n: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): a row (doc_id, h, n_shingles, key) for each of docs, and (key, root) of the sets that link with others."""
    spark = tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    signed = Scratch(docs.mapInArrow(_signed(n, share), "doc_id long, h long, n_shingles long, key binary, signs array<bigint>, class int, need int, below int"), "signed")
    rows = written(signed.df.drop("signs", "class", "need", "below"), "rows")
    cluster = written(_clusters(signed.df, share < COUNTED_BELOW), "clusters")
    signed.drop()
    ids = rows.where("key is not null").select(F.xxhash64("doc_id", "h").alias("h"), "key", F.xxhash64("key").alias("id")).join(even(cluster), "id")
    active = written(ids.groupBy("key", "region").agg(F.min("h").alias("h")), "active")  # of equal sets, one document
    mask = spark.sparkContext.broadcast(_bitmap(active.select("h"), active.count()))

    def wanted(batches):
        on, shingle = mask.value, Shingler(n)
        last = np.int64(len(on) * 8 - 1)
        for b in batches:
            at = b.column("h").to_numpy() & last
            keep = np.flatnonzero(on[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            found = [(s.tobytes(), len(s)) for t in b.column("text").take(pa.array(keep)) if len(s := shingle(t.as_py()))]
            if found:
                raw, size = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in raw], pa.binary()), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["key", "n", "set"])

    sets = docs.select("text", F.xxhash64("doc_id", "h").alias("h")).mapInArrow(wanted, "key binary, n long, set binary")
    sets = sets.groupBy("key").agg(F.first("n").alias("n"), F.first("set").alias("set"))  # rows may repeat
    members = written(sets.join(even(active.select("key", F.encode(F.col("region").cast("string"), "utf-8").alias("region"))), "key").select("region", "key", "n", "set"), "sets")
    links = join_regions(members, share)
    return rows, written(connected(_all(links)).select(F.col("node").alias("key"), "root"), "groups")


def jaccard_components(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id that links reach, links being 100 |A and B| >= share |A or B|.

    Sets are the distinct n-word shingles of whole texts, words being parted by ASCII white space and A-Z
    lower-cased; a text of fewer words is one shingle; a text without words, or null, has none and
    links with nothing. One row per row of docs, repeated ids too. A null id takes part in links but is never a
    component's id; where nothing else is in its component, that is null. An empty table gives none.
    """
    rows, groups = _grouped(docs, n, share)
    some = rows.where("key is not null")
    found = some.join(even(groups), "key").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = some.groupBy("key").agg(F.min("doc_id").alias("own"))
    by_key = least.join(even(groups), "key", "left").join(even(found), "root", "left").select("key", F.coalesce("component_id", "own").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "key").join(even(by_key), "key").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """docs without near duplicates: of each component one row stays, that of the least doc_id, and of equal ids of the least text hash.

    A null id comes last. Rows without words stay. Rows that repeat doc_id and text are copies like others: one stays. All columns of docs
    stay as they are. An empty table gives none.
    """
    rows, groups = _grouped(docs, n, share)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    some = rows.where("key is not null").select("key", place.alias("at"))
    by_key = some.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("c")).join(even(groups), "key", "left")
    several = written(by_key.where("c > 1 or root is not null").select("key", F.coalesce("root", "key").alias("root"), "first"), "several")
    keep = several.groupBy("root").agg(F.min("first").alias("keep"))
    copies = some.join(even(several.join(even(keep), "root").select("key", "keep")), "key").groupBy("at", "keep").agg(F.count("*").alias("c"))
    # what to do with all rows of an id and a text: remove them, or all but one
    todo = written(copies.where("at <> keep or c > 1").select(F.col("at.doc_id").alias("__id"), F.col("at.h").alias("__h"), (F.col("at") == F.col("keep")).alias("__one")), "copies")
    own = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__h"))
    stay = own.join(even(todo), same, "left_anti").select(docs.columns)
    return stay.unionAll(own.join(even(todo.where("__one")), same).dropDuplicates(["__id", "__h"]).select(docs.columns))
