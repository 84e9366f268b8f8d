"""Token counts without ids: pieces are counted once per distinct pre-token and joined to frequencies.

Tasks split their documents once, in chunks. Of a chunk they write the frequencies of its distinct
pre-tokens in its documents, and the pre-tokens themselves in rows by a hash of them. Rows of one hash
meet in a task, where the tokenizer sees each distinct pre-token once; the counts go back to the
chunks, where they are multiplied with the frequencies and summed per document.

Pre-tokens that are vocabulary entries and encode to themselves cost one token. They are added up
where they are found, which takes the most frequent ones out of the join.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tune, written

#: A chunk ends at so many characters or documents.
CHUNK_CHARS, CHUNK_DOCS = 1 << 24, 1 << 15
#: Rows that a chunk's pre-tokens are dealt to, and counts of pre-tokens that a task remembers before it forgets all.
BUCKETS, REMEMBERED = 1024, 1 << 22


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _known(path: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """(texts of vocabulary entries that encode to themselves, texts of added tokens)."""
    t = tokenizer(path)
    added = tuple(sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True))
    entries = [t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size(with_added_tokens=False))]
    entries = [x for x in entries if x and "�" not in x]
    return frozenset(x for x, e in zip(entries, t.encode_batch(entries, add_special_tokens=False)) if len(e.ids) == 1), added


def _segments(text: str, added: tuple[str, ...]):
    """Lists of pre-tokens of a text; an added token's text, wherever it stands, is a pre-token of its own."""
    if not any(a in text for a in added):
        yield from pieces(text)
        return
    import re

    for k, part in enumerate(re.split("(" + "|".join(map(re.escape, added)) + ")", text)):
        if k % 2:
            yield [part]
        elif part:
            yield from pieces(part)


class _Numbers(dict):
    """Numbers pre-tokens in the order they come; known single tokens get -1."""

    def __init__(self, single: frozenset[str]):
        self.single, self.names = single, []

    def __missing__(self, piece: str) -> int:
        if piece in self.single:
            n = -1
        else:
            n = len(self.names)
            self.names.append(piece)
        self[piece] = n
        return n


_HEAD = np.dtype([("d", "<i8"), ("no_id", "?"), ("bytes", "<i8"), ("direct", "<i8")])
_CHUNK = "chunk long, bucket int, pieces binary, heads binary, posts binary"


def _packed(texts: list[bytes]) -> bytes:
    """Byte strings as their number, their lengths and themselves."""
    return b"".join([len(texts).to_bytes(4, "little"), np.fromiter(map(len, texts), "<u4", len(texts)).tobytes(), *texts])


def _unpacked(raw: bytes) -> list[str]:
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * n + 4).tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([4 * n + 4, *ends], ends)]


def _chunks(batches, path: str):
    """A chunk's rows: one with its documents in order and the postings, and one for each bucket with its pre-tokens.

    Pre-tokens are numbered by bucket; postings are how many each has, then their documents, then their frequencies.
    """
    from pyspark import TaskContext

    single, added = _known(path)
    base = TaskContext.get().partitionId() << 32
    number, ids, doc_of, head, chars = _Numbers(single), [], [], [], 0

    def flush():
        names = [x.encode("utf-8", "surrogatepass") for x in number.names]
        bucket = np.fromiter((zlib.crc32(x) % BUCKETS for x in names), np.int64, len(names))
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        flat = rank[np.concatenate(ids)] * CHUNK_DOCS + np.repeat(np.array(doc_of, np.int64), [len(x) for x in ids]) if names else np.zeros(0, np.int64)
        pair, freq = np.unique(flat, return_counts=True)
        count = np.bincount(pair // CHUNK_DOCS, minlength=len(names)).astype("<u4")
        posts = count.tobytes() + (pair % CHUNK_DOCS).astype("<u2").tobytes() + freq.astype("<u4").tobytes()
        heads = np.array([(d or 0, d is None, b, t) for d, b, t in head], _HEAD).tobytes()
        ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).tolist()
        rows = [(base, -1, None, heads, posts)]
        rows += [(base, k, _packed([names[i] for i in order[a:b].tolist()]), None, None) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["chunk", "bucket", "pieces", "heads", "posts"])

    for b in batches:
        for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            direct = 0
            for part in _segments(text, added) if text else ():
                own = np.fromiter(map(number.__getitem__, part), np.int64, len(part))
                rest = own[own >= 0]
                direct += len(own) - len(rest)
                ids.append(rest)
                doc_of.append(len(head))
            chars += len(text or "")
            head.append((d, len((text or "").encode("utf-8", "surrogatepass")), direct))
            if chars >= CHUNK_CHARS or len(head) >= CHUNK_DOCS:
                yield from flush()
                number, ids, doc_of, head, chars, base = _Numbers(single), [], [], [], 0, base + 1
    if head:
        yield from flush()


def _counted(batches, path: str):
    """Rows (chunk, bucket, pieces) -> (chunk, bucket, n): the token counts of the pre-tokens, in order."""
    t = tokenizer(path)
    t.no_padding()
    t.no_truncation()
    known: dict[str, int] = {}
    for b in batches:
        rows = [_unpacked(x) for x in b.column("pieces").to_pylist()]
        new = list({p for row in rows for p in row} - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for row in rows for p in row})
        known.update(zip(new, (len(e.ids) for e in t.encode_batch(new, add_special_tokens=False))))
        n = [np.fromiter(map(known.__getitem__, row), "<u4", len(row)).tobytes() for row in rows]
        yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("bucket"), pa.array(n, pa.binary())], names=["chunk", "bucket", "n"])


def _summed(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with their sums: frequencies times counts, and the pre-tokens of one token."""
    head = np.frombuffer(chunk["heads"][0].as_py(), _HEAD)
    raw = chunk["posts"][0].as_py()
    rows = sorted(zip(counts["bucket"].to_pylist(), counts["n"].to_pylist()))
    n = np.frombuffer(b"".join(x for _, x in rows), "<u4").astype(np.int64)
    times = np.frombuffer(raw, "<u4", len(n))
    total = int(times.sum(dtype=np.int64))
    doc = np.frombuffer(raw, "<u2", total, 4 * len(n))
    freq = np.frombuffer(raw, "<u4", total, 4 * len(n) + 2 * total)
    sums = np.zeros(len(head), np.int64)
    np.add.at(sums, doc, freq * np.repeat(n, times))
    return pa.table({"doc_id": pa.array(head["d"], mask=head["no_id"]), "n_bytes": pa.array(head["bytes"]), "n_tokens": pa.array(sums + head["direct"])})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id (bigint), n_bytes (UTF-8), n_tokens as the tokenizers file at `path` gives them.

    No begin, end or added special tokens are put in; the text of an added token inside a document
    is that token, as the library has it by default. A null text counts as empty: 0 and 0. Repeated
    rows and null ids keep a row each. Only doc_id and text are read. An empty table gives none.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(docs.mapInArrow(lambda b: _chunks(b, path), _CHUNK), "chunks")
    rows = chunks.where("bucket >= 0").select("chunk", "bucket", "pieces").repartition("bucket")
    counts = rows.mapInArrow(lambda b: _counted(b, path), "chunk long, bucket int, n binary")
    whole = chunks.where("bucket < 0").select("chunk", "heads", "posts")
    return whole.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
