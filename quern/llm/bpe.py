"""Byte-level BPE by a hierarchical-bitmap rank queue, and token counts per distinct pre-token.

The queue has a bucket for each merge rank. A bucket holds positions of a linked list of parts; a
bitmap of three levels marks the buckets that aren't empty, so that find-first-set gives the next
rank in three steps. A merge links around its right part and queues the two new neighbours; an entry
whose parts have changed since is stale and is skipped when it comes up. A pre-token of n bytes so
takes O(n log n) at worst, however long it is.

Encoder runs one queue over many pre-tokens at once: their lists stand one after another, and the
positions of a rank are merged together, leftmost first. A pre-token in which a merge makes a rank
that isn't later than the present one could need another order; it is done again on its own, one
position at a time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import pieces, tune

#: Distinct pre-tokens (and their bytes) that a worker remembers before it forgets all.
CACHE_PIECES, CACHE_BYTES = 1 << 19, 1 << 26


class RankQueue:
    """Ranks below 64**3 with a bucket each; pop gives the least rank that has entries."""

    def __init__(self):
        self.top, self.mid, self.low, self.bucket = 0, {}, {}, {}

    def push(self, rank: int, entry) -> list:
        found = self.bucket.get(rank)
        if found is None:
            found = self.bucket[rank] = []
            a, b = rank >> 12, rank >> 6
            self.top |= 1 << a
            self.mid[a] = self.mid.get(a, 0) | 1 << (b & 63)
            self.low[b] = self.low.get(b, 0) | 1 << (rank & 63)
        found.append(entry)
        return found

    def first(self) -> int:
        """The least rank, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        m = self.low[b]
        return b << 6 | (m & -m).bit_length() - 1

    def take(self, rank: int) -> list:
        a, b = rank >> 12, rank >> 6
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return self.bucket.pop(rank)


class Encoder:
    """Encodes pre-tokens by the ranks of a tiktoken file; decodes ids."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                a, b = line.split()
                ranks[base64.b64decode(a)] = int(b)
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pair = {}
        for k, v in ranks.items():
            for i in range(1, len(k)):
                if (a := ranks.get(k[:i])) is not None and (b := ranks.get(k[i:])) is not None:
                    pair[a << 32 | b] = v
        self.pair = pair
        self.keys = np.array(sorted(pair), np.int64)
        self.values = np.array([pair[k] for k in self.keys.tolist()], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.values[i], -1)

    def one(self, piece: bytes) -> list[int]:
        """A single pre-token, strictly the leftmost entry of the least rank at a time."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, pair, queue = len(ids), self.pair, RankQueue()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < n and (r := pair.get(ids[i] << 32 | ids[nxt[i]])) is not None:
                if r in queue.bucket:
                    heapq.heappush(queue.bucket[r], (i, ids[i], nxt[i], ids[nxt[i]]))
                else:
                    queue.push(r, (i, ids[i], nxt[i], ids[nxt[i]]))

        for i in range(n - 1):
            offer(i)
        while (r := queue.first()) >= 0:
            i, a, j, b = heapq.heappop(queue.bucket[r])
            if not queue.bucket[r]:
                queue.take(r)
            if ids[i] != a or nxt[i] != j or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            offer(prv[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def many(self, todo: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(todo)
        hard = []
        for k, p in enumerate(todo):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > 4096:
                out[k] = np.array(self.one(p), "<u4").tobytes()
            elif p:
                hard.append(k)
        if hard:
            self._together(todo, hard, out)
        return out

    def _together(self, todo: list[bytes], hard: list[int], out: list[bytes]) -> None:
        size = np.array([len(todo[k]) for k in hard], np.int64)
        piece = np.repeat(np.arange(len(hard)), size)
        ids = self.byte_id[np.frombuffer(b"".join([todo[k] for k in hard]), np.uint8)]
        n = len(ids)
        ids = np.append(ids, -1)
        last = np.cumsum(size) - 1
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[last] = n  # n: no neighbour
        prv[last - size + 1] = n
        odd = np.zeros(len(hard), bool)
        queue = RankQueue()

        def offer(i: np.ndarray, now: int) -> None:
            i = i[i < n]
            j = nxt[i]
            i, j = i[j < n], j[j < n]
            r = self._rank(ids[i], ids[j])
            ok = r >= 0
            i, j, r = i[ok], j[ok], r[ok]
            if now >= 0 and (bad := r <= now).any():
                odd[piece[i[bad]]] = True
            by = np.argsort(r, kind="stable")
            i, j, r = i[by], j[by], r[by]
            cut = np.flatnonzero(np.diff(r, prepend=-1)).tolist()
            for s, e, rank in zip(cut, [*cut[1:], len(r)], r[cut].tolist()):
                if rank > now:
                    queue.push(rank, (i[s:e], j[s:e], ids[i[s:e]], ids[j[s:e]]))

        offer(np.arange(n), -1)
        while (r := queue.first()) >= 0:
            got = queue.take(r)
            i, j, a, b = got[0] if len(got) == 1 else (np.concatenate(x) for x in zip(*got))
            ok = (ids[i] == a) & (nxt[i] == j) & (ids[j] == b)  # others are stale
            i = np.unique(i[ok]) if len(got) > 1 else i[ok]
            if not len(i):
                continue
            j = nxt[i]
            if len(i) > 1 and (chain := np.append(False, j[:-1] == i[1:])).any():
                at = np.arange(len(i))
                begin = np.maximum.accumulate(np.where(chain, 0, at))
                keep = (at - begin) % 2 == 0  # overlapping entries: each second, from the left
                i, j = i[keep], j[keep]
            ids[i], ids[j] = r, -1
            far = nxt[j]
            nxt[i] = far
            prv[far[far < n]] = i[far < n]
            offer(np.unique(np.concatenate([i, prv[i]])), r)
        alive = np.flatnonzero(ids[:n] >= 0)
        flat = ids[alive].astype("<u4").tobytes()
        count = np.bincount(piece[alive], minlength=len(hard))
        end = np.cumsum(count) * 4
        for k, e, c, bad in zip(hard, end.tolist(), count.tolist(), odd.tolist()):
            out[k] = np.array(self.one(todo[k]), "<u4").tobytes() if bad else flat[e - 4 * c : e]


_encoders: dict[str, tuple[Encoder, dict[str, bytes]]] = {}


def encoder(path: str) -> tuple[Encoder, dict[str, bytes]]:
    """The worker's encoder for a rank file, with the ids of pre-tokens it has met."""
    if path not in _encoders:
        _encoders[path] = (Encoder(path), {})
    return _encoders[path]


def encode_texts(texts: list[str | None], path: str) -> Iterator[Iterator[bytes]]:
    """For each text, its ids in parts of little-endian unsigned 32-bit integers.

    Each text is split once. The new pre-tokens of texts that are short together go through one queue.
    """
    enc, known = encoder(path)

    def learn(parts: list[list[str]]) -> None:
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > CACHE_PIECES or sum(map(len, new)) > CACHE_BYTES:
            known.clear()
            new = set().union(*parts)
        if new:
            known.update(zip(new, enc.many([p.encode("utf-8", "surrogatepass") for p in new])))

    def long(text: str) -> Iterator[bytes]:
        for part in pieces(text):
            learn([part])
            yield b"".join(map(known.__getitem__, part))

    def together(some: list[str | None]) -> Iterator[Iterator[bytes]]:
        parts = [next(pieces(t)) if t else [] for t in some]
        learn(parts)
        for part in parts:
            yield iter((b"".join(map(known.__getitem__, part)),))

    held, size = [], 0
    for t in texts:
        n = len(t or "")
        if held and size + n > 1 << 21:
            yield from together(held)
            held, size = [], 0
        if n > 1 << 20:
            yield long(t)
        else:
            held.append(t)
            size += n
    yield from together(held)


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """docs with n_tokens and ids_sha256, decoded_sha256 (lower-case hex) and, with `ids`, input_ids (array of int).

    Each match of the split pattern is encoded separately, without special tokens. A null text counts
    as empty: no ids. Every column of docs is kept; columns of these names are replaced.
    """
    tune(docs.sparkSession)
    new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"input_ids": "array<int>"} if ids else {})
    docs = docs.drop(*new, "input_ids")
    keep = docs.columns

    def run(batches):
        for b in batches:
            cols = {k: [] for k in new}
            for parts in encode_texts(b.column("text").to_pylist(), path):
                table = encoder(path)[0].bytes
                h, d, n, own = hashlib.sha256(), hashlib.sha256(), 0, []
                for raw in parts:
                    h.update(raw)
                    some = np.frombuffer(raw, "<u4")
                    d.update(b"".join(map(table.__getitem__, some.tolist())))
                    n += len(some)
                    if ids:
                        own.append(some.astype(np.int32))
                cols["n_tokens"].append(n)
                cols["ids_sha256"].append(h.hexdigest())
                cols["decoded_sha256"].append(d.hexdigest())
                if ids:
                    cols["input_ids"].append(np.concatenate(own) if own else [])
            kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), *(pa.array(v, kinds[new[k]]) for k, v in cols.items())], names=[*keep, *new]
            )

    kinds = {"bigint": LongType(), "string": StringType(), "array<int>": ArrayType(IntegerType())}
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(k, kinds[v]) for k, v in new.items())]))


def decoded(tokens: DataFrame, path: str, column: str = "input_ids") -> DataFrame:
    """tokens with decoded (binary): the bytes of the ids in `column`; a null or empty list gives no bytes."""
    tokens = tokens.drop("decoded")
    keep = tokens.columns

    def run(batches):
        for b in batches:
            table = encoder(path)[0].bytes
            own = [b"".join(map(table.__getitem__, x or ())) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(own, pa.binary())], names=[*keep, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", BinaryType())]))
