"""Benchmark decontamination by training suffix arrays.

Documents are cut into shards as they stream through a task. Each shard gets a word-level suffix
array; every suffix of the benchmark is binary-searched in it, which gives its longest verbatim
match and all places of that match, and the places of every window of an item. Nothing is
shuffled: a document lies in one shard, and a hot source is only more shards.

Only runs of words that the benchmark knows, at least as long as the shortest window, enter the
suffix array: a match cannot contain any other word, so nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words: bytes of UTF-8 that are 0-9, a-z (after lower-casing A-Z) or not ASCII; all others separate.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW = 10
#: Bytes of benchmark text that are searched at once; more go through the documents in further blocks.
BLOCK_BYTES = 16 << 20
#: Words that one shard's suffix array holds, and words read before it is built at the latest.
SHARD_KEPT, SHARD_READ = 1 << 20, 1 << 22


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Block:
    """One block of the benchmark: its word ids, suffixes and windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        flat: list[int] = [0]
        self.suffix, self.left = [], []  # start of each suffix, words from there to the item's end
        seen: dict[tuple[int, ...], int] = {}
        self.win_at, self.win_len, self.win_items = [], [], []
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            if not w:
                continue
            at, size = len(flat), min(window, len(w))
            flat += w + [0]
            self.suffix += range(at, at + len(w))
            self.left += range(len(w), 0, -1)
            for i in range(len(w) - size + 1):
                k = seen.setdefault(tuple(w[i : i + size]), len(seen))
                if k == len(self.win_at):
                    self.win_at.append(at + i)
                    self.win_len.append(size)
                    self.win_items.append(set())
                if item is not None:
                    self.win_items[k].add(item)
        self.test = np.array(flat, np.int32)
        self.suffix, self.left = np.array(self.suffix, np.int64), np.array(self.left, np.int64)
        self.win_at, self.win_len = np.array(self.win_at, np.int64), np.array(self.win_len, np.int64)
        self.least = int(self.win_len.min()) if len(self.win_len) else 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes (at words other than 0), sorted by their first `depth` words at least, by prefix doubling."""
    n, k = len(text), 1
    rank = text.astype(np.int64)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:]
        key = np.where(text > 0, rank << 32 | nxt, 0)
        distinct, rank = np.unique(key, return_inverse=True)
        k *= 2
        if len(distinct) >= n or k >= depth:
            break
    order = np.argsort(rank, kind="stable")
    return order[text[order] > 0]


def _common(test: np.ndarray, q: np.ndarray, text: np.ndarray, s: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that test[q:] and text[s:] have in common at their start, `most` at most."""
    out = np.zeros(len(q), np.int64)
    live = np.flatnonzero(most > 0)
    d = 0
    while len(live):
        live = live[test[q[live] + d] == text[s[live] + d]]
        d += 1
        out[live] = d
        live = live[most[live] > d]
    return out


def bounds(test: np.ndarray, q: np.ndarray, size: np.ndarray, text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix, cut to `size` words: the range of the suffix array that begins with it."""
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            s, qq, most = sa[mid], q[live], size[live]
            same = _common(test, qq, text, s, most)
            full = same >= most
            d = np.minimum(same, most - 1)
            right = np.where(full, upper, text[s + d] < test[qq + d])
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


def search(block: Block, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of windows, their windows; places of longest matches, their lengths) in one shard."""
    none = np.zeros(0, np.int64)
    if not len(text) or not len(block.suffix):
        return none, none, none, none
    text = np.concatenate([text, np.zeros(1, np.int32)])
    sa = suffix_array(text, int(block.left.max()) + 1)
    lo, _ = bounds(block.test, block.suffix, block.left, text, sa)
    best = np.zeros(len(lo), np.int64)
    for near in (lo - 1, lo):
        ok = (near >= 0) & (near < len(sa))
        best[ok] = np.maximum(best[ok], _common(block.test, block.suffix[ok], text, sa[near[ok]], block.left[ok]))
    def places(q, size):
        a, b = bounds(block.test, q, size, text, sa)
        n = b - a
        which = np.repeat(np.arange(len(q)), n)
        return sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)], which
    at, win = places(block.win_at, block.win_len)
    long = np.flatnonzero(best >= block.least)
    far, which = places(block.suffix[long], best[long])
    return at, win, far, best[long][which]


def _shards(block: Block, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept, at_doc, at_word, n_kept, n_read, held = [], [], [], 0, 0, []

    def finish():
        text = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        doc, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at_doc, at_word))
        at, win, far, far_len = search(block, text)
        n = sum(len(b) for b, _ in held)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc[far], far_len)
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + block.win_len[win], -1)
        hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        starts = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
        spans: dict[int, list[int]] = {}
        for a, b in zip(hit[starts], hit[np.append(starts[1:] - 1, -1)] if len(starts) else ()):
            spans.setdefault(int(doc[a]), []).extend((int(pos[a]), int(pos[b]) + 1))
        found: dict[int, set] = {}
        for pair in np.unique(doc[at] * len(block.win_at) + win).tolist():
            found.setdefault(pair // len(block.win_at), set()).update(block.win_items[pair % len(block.win_at)])
        i = 0
        for b, counts in held:
            cols = {x: b.column(x) for x in b.schema.names}
            here = range(i, i + len(b))
            i += len(b)
            old = [cols[x].to_pylist() for x in ("hit_spans", "hit_items", "longest_match")]
            cols["n_words"] = pa.array(counts, pa.int64())
            cols["hit_spans"] = pa.array([merged(o or [], spans.get(k, [])) for o, k in zip(old[0], here)], pa.list_(pa.int64()))
            cols["hit_items"] = pa.array([sorted({*(o or ()), *found.get(k, ())}) for o, k in zip(old[1], here)], pa.list_(pa.string()))
            cols["longest_match"] = pa.array([max(o or 0, int(longest[k])) for o, k in zip(old[2], here)], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)

    n_doc = 0
    for b in batches:
        counts = []
        for text in b.column("text"):
            w = words(text.as_py())
            counts.append(len(w))
            n_read += len(w)
            if len(w) >= block.least > 0:
                ids = np.fromiter(map(block.ids.get, w, _zeros()), np.int32, len(w))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - s >= block.least:
                        kept.append(np.append(ids[s:e], np.int32(0)))
                        at_doc.append(np.full(e - s + 1, n_doc))
                        at_word.append(np.arange(s, e + 1))
                        n_kept += e - s + 1
            n_doc += 1
        held.append((b, counts))
        if n_kept >= SHARD_KEPT or n_read >= SHARD_READ:
            yield from finish()
            kept, at_doc, at_word, n_kept, n_read, held, n_doc = [], [], [], 0, 0, [], 0
    if held:
        yield from finish()


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of half-open spans, each as start, end, start, end, ..."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_spans (word positions: start, end, ...), hit_items (sorted texts of item ids) and longest_match.

    Every column of docs is kept; columns of these four names are replaced. A null text has no words.
    An item with fewer words than `window` is one window, one without words none; an item without
    an id marks words but isn't listed; repeated items count once. The benchmark goes to the executors
    in blocks of BLOCK_BYTES of text, each block over all documents, so that what is broadcast is bounded.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    out = docs.drop("n_words", "hit_spans", "hit_items", "longest_match").selectExpr(
        "*", "0L n_words", "cast(null as array<bigint>) hit_spans", "cast(null as array<string>) hit_items", "0L longest_match"
    )
    for k in range(n):
        block = Block([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window)
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            first = next(batches, None)
            if first is not None:
                schema = first.schema
                for name, kind in (("n_words", pa.int64()), ("hit_spans", pa.list_(pa.int64())), ("hit_items", pa.list_(pa.string())), ("longest_match", pa.int64())):
                    schema = schema.set(schema.get_field_index(name), pa.field(name, kind))
                import itertools

                yield from _shards(sent.value, itertools.chain([first], batches), schema)

        out = out.mapInArrow(run, out.schema)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with no word inside an occurrence of a benchmark window, with the columns of docs, whatever their names."""
    aside = {c: f"__{c}" for c in docs.columns if c in ("n_words", "hit_spans", "hit_items", "longest_match")}
    own = docs.withColumnsRenamed(aside)
    clean = contamination(own, benchmark, window).where(F.size("hit_items") + F.size("hit_spans") == 0).select(own.columns)
    return clean.withColumnsRenamed({v: k for k, v in aside.items()})
