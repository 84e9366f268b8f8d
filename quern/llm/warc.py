"""WARC archives as a chunked record table.

Writing: a payload is hashed over slices of its Arrow buffer and, if it is longer than a chunk, goes
out as a WARC segmentation: a first record and continuation records, each a row of bounded size that
carries its record's identifier and chunk number. Rows become archive files through Spark's text
sink, whose line separator is the blank lines that end a WARC record, so any store that Spark writes to will do.

Reading: the text source splits files at the start line of the next record, wherever a split of a
file begins. A chunk never holds that start line: payloads are also cut inside it. Chunks of a record
come together sorted, and a digest is carried from one to the next; no record is ever whole in memory.

Payloads that are equal are stored once: the row with the largest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, tune, written

CHUNK = 1 << 16
#: More revisits than this are joined by a shuffle instead of being sent to every executor.
SEND_ROWS = 50_000
_START, _END = "WARC/1.1\r\n", "\r\n\r\n"
_CUT = b"\r\n\r\nWARC/1.1"
_URN = "urn:quern:page:"


def _views(column: pa.Array):
    """A memory view of each string of an Arrow column, empty for null."""
    column = column.cast(pa.large_binary())
    for v in column:
        b = v.as_buffer()
        yield memoryview(b) if b is not None else memoryview(b"")


def _base32(h) -> str:
    return base64.b32encode(h.digest()).decode()


def slices(view: memoryview, chunk: int):
    """(start, end) of a payload's chunks: at most `chunk` bytes, no character split, no record start line whole."""
    n, at = len(view), 0
    while at < n or at == 0:
        end = min(n, at + chunk)
        while end < n and end > at + 1 and view[end] & 0xC0 == 0x80:
            end -= 1
        cut = bytes(view[at : min(n, end + len(_CUT))]).find(_CUT)
        if 0 <= cut and at + cut + 5 < n:
            end = min(end, at + cut + 5)
        yield at, end
        at = end
        if at >= n:
            return


def _payload(html: str) -> list[Column]:
    """n and digest: bytes and SHA-1 of a payload, empty for null."""
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return [F.octet_length(raw).cast("long").alias("n"), F.sha1(raw).alias("digest")]


def revisits(pages: DataFrame, html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, n, digest, refers_to) of payloads, of `least` bytes at least, that a row with a larger page_id has too."""
    some = pages.where("page_id is not null").select("page_id", *_payload(html)).where(F.col("n") >= least)
    first = some.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    return some.join(first, ["digest", "n"]).where("page_id < refers_to").select("page_id", "n", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, html: str = "html", least: int = 0, chunk: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record per row of pages (page_id, url, html) to archive files under `path`.

    A null html is an empty payload. A row without page_id is a response. Rows that repeat a page_id
    keep a record each, whatever their payloads; of equal payloads under the largest page_id each is a response.
    An empty table gives no record.
    """
    spark = tune(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias(html))
    again = written(revisits(pages, html, least), "revisits")
    own = pages.select("page_id", "url", html, *_payload(html))  # a page_id may repeat with other payloads
    rows = own.join(F.broadcast(again) if again.count() <= SEND_ROWS else again, ["page_id", "n", "digest"], "left").select("page_id", "url", html, "refers_to")

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), itertools.count()
        for b in batches:
            out = []
            size = 0
            for page, url, first, v in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("refers_to").to_pylist(), _views(b.column(html))):
                own = f"{_URN}{'' if page is None else page}:{part}-{next(number)}"
                h = hashlib.sha1()
                cuts = list(slices(v, chunk))
                for s, e in cuts:
                    h.update(v[s:e])
                head = [
                    f"WARC-Type: {'response' if first is None else 'revisit'}",
                    f"WARC-Record-ID: <{own}>",
                    f"WARC-Date: {date}",
                    f"WARC-Payload-Digest: sha1:{_base32(h)}",
                    "Content-Type: application/http; msgtype=response",
                ]
                if url:
                    head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(v)}\r\n\r\n"
                if first is not None:
                    head += [f"WARC-Refers-To: <{_URN}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                    cuts = [(0, 0)]
                elif len(cuts) > 1:
                    head.append("WARC-Segment-Number: 1")
                for k, (s, e) in enumerate(cuts):
                    block = (http if k == 0 else "") + str(v[s:e], "utf-8", "surrogatepass")
                    if k:
                        head = ["WARC-Type: continuation", f"WARC-Record-ID: <{own}:{k + 1}>", f"WARC-Date: {date}", f"WARC-Segment-Origin-ID: <{own}>", f"WARC-Segment-Number: {k + 1}"]
                        if k + 1 == len(cuts):
                            head.append(f"WARC-Segment-Total-Length: {len(http) + len(v)}")
                    out.append(_START + "\r\n".join(head) + f"\r\nContent-Length: {len(block.encode())}\r\n\r\n" + block)
                    size += e - s
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", _END).text(path)


def _header(raw: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.split("\r\n"))}


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """(record, chunk, kind, page_id, refers_to, n, digest, payload): a row per WARC record under `path`.

    n is the payload's length as the HTTP header tells it and digest the WARC header's; both are null
    for continuation records. payload has the bytes of this chunk.
    """
    tune(spark)
    names = ["record", "chunk", "kind", "page_id", "refers_to", "n", "digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(urn: str | None) -> int | None:
        text = (urn or "").strip("<>").removeprefix(_URN).split(":")[0]
        return int(text) if text else None

    def run(batches):
        for b in batches:
            rows = []
            for v in _views(b.column("value")):
                raw = bytes(v)
                raw = raw.removeprefix(_START.encode())
                at = raw.find(b"\r\n\r\n")
                if at < 0:
                    continue
                head = _header(raw[:at].decode("utf-8", "surrogatepass"))
                block = raw[at + 4 : at + 4 + int(head["content-length"])]
                kind = head["warc-type"]
                if kind == "continuation":
                    rows.append((head["warc-segment-origin-id"], int(head["warc-segment-number"]), kind, None, None, None, None, block))
                    continue
                at = block.find(b"\r\n\r\n")
                n = int(_header(block[:at].decode())["content-length"])
                rows.append((head["warc-record-id"], 1, kind, number(head["warc-record-id"]), number(head.get("warc-refers-to")), n, head["warc-payload-digest"].removeprefix("sha1:"), block[at + 4 :]))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    lines = spark.read.option("lineSep", _END + _START).text(path)
    return lines.mapInArrow(run, "record string, chunk long, kind string, page_id long, refers_to long, n long, digest string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records under `path`.

    Length and digest of a response are those of the bytes read; a difference from the record's own
    header is an error. A revisit has those of its header. Whole records need no shuffle of bytes: only
    the chunks of segmented ones travel.
    """
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def alone(batches):
        """Digests records that are in one chunk, and drops their bytes."""
        for b in batches:
            n, payload = b.column("n").to_pylist(), []
            for k, v in enumerate(_views(b.column("payload"))):
                if n[k] is not None and (b.column("kind")[k].as_py() == "revisit" or len(v) == n[k]):
                    if b.column("kind")[k].as_py() != "revisit" and _base32(hashlib.sha1(v)) != b.column("digest")[k].as_py():
                        raise ValueError(f"digest of {b.column('record')[k]} differs")
                    payload.append(None)
                else:
                    payload.append(bytes(v))
            yield b.set_column(b.schema.get_field_index("payload"), "payload", pa.array(payload, pa.binary()))

    def carried(batches):
        state = None  # (record, first row, digest so far, bytes so far)

        def finish(x):
            record, first, h, n = x
            if n != first["n"] or _base32(h) != first["digest"]:
                raise ValueError(f"record {record} differs from its header: {n} bytes of {first['n']}")
            return first["page_id"], n, first["digest"], first["kind"], first["refers_to"]

        for b in batches:
            rows = []
            for k, r in enumerate(b.drop_columns(["payload"]).to_pylist()):
                part = b.column("payload")[k]
                if state and state[0] != r["record"]:
                    rows.append(finish(state))
                    state = None
                if not part.is_valid:
                    rows.append((r["page_id"], r["n"], r["digest"], r["kind"], r["refers_to"]))
                    continue
                if state is None:
                    state = (r["record"], r, hashlib.sha1(), 0)
                view = memoryview(part.as_buffer())
                state[2].update(view)
                state = (*state[:3], state[3] + len(view))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=out)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(finish(state), kinds)], names=out)

    table = chunk_table(spark, path)
    table = table.mapInArrow(alone, table.schema).repartition("record").sortWithinPartitions("record", "chunk")
    return table.mapInArrow(carried, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path)
