"""WARC records in a chunked record table.

An archive is a table of rows ``(record, chunk, n_chunks, bytes, digest_so_far)`` in Parquet: the
bytes of a record's chunks, in order, are one WARC record, and all records make a WARC file. A chunk
holds at most ``chunk_bytes`` of the payload, and carries the SHA-256 of the payload up to its end.
Writer and reader handle a chunk at a time: no record is put together in memory.

Of records with equal payloads of at least ``min_revisit`` bytes, that of the smallest id is a
``response``; the others are ``revisit`` records that name it and hold HTTP headers only. Which is
which is settled on ids and digests; a payload is shuffled only if its record may be the response of
a group, so the payloads of a hot group's revisits never are.

Defined results: a null payload counts as empty. A null id is written without a name and read back as
null; it never is the record that others refer to, unless the group has no other, in which case all
of the group are responses. Rows that repeat the smallest id and its payload are responses each. White
space in a URL is written percent-encoded. Ids may have any type whose values Spark casts to strings
and back; the smallest is the smallest of that type. Extra columns are not read and may have any name.
A payload is one value of a row, so it goes up to Spark's 2 GB; records are never put together. An empty table
gives archives without records and an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.text import once, small_batches
from gridweave.operators.membership import build_filter, maybe
from gridweave.plans.staging import materialise, new_path

CHUNK_BYTES = 1 << 20
#: Bytes of chunks that the writer hands over at a time.
BATCH_BYTES = 4 << 20
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE = "record bigint, chunk bigint, n_chunks bigint, bytes binary, digest_so_far string"
END = b"\r\n\r\n"


def _urn(id_: str | None) -> str:
    return "<urn:page>" if id_ is None else f"<urn:page:{quote(id_, safe='')}>"


def _id(urn: str | None) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn.startswith("<urn:page:") else None


def _head(id_: str | None, url: str | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """WARC and HTTP headers of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: {_urn(id_)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in " \t\r\n\v\f" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + END + http


def record_chunks(id_: str | None, url: str | None, payload: memoryview, size: int, digest: str, refers_to: str | None, chunk_bytes: int) -> Iterator[tuple[int, int, bytes, str]]:
    """``(chunk, n_chunks, bytes, digest_so_far)`` of one record, whose payload has ``size`` bytes."""
    body = payload if refers_to is None else payload[:0]
    n = max(1, -(-len(body) // chunk_bytes))
    running = hashlib.sha256()
    for k in range(n):
        part = body[k * chunk_bytes : (k + 1) * chunk_bytes]
        running.update(part)
        data = (_head(id_, url, digest, size, refers_to) if k == 0 else b"") + bytes(part) + (END if k == n - 1 else b"")
        yield k, n, data, running.hexdigest()


def decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """``(id, url, payload, n_bytes, digest, refers_to)`` for each row; revisits come without payload."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = once(rows, n_bytes=F.octet_length("payload").cast("bigint"), digest=F.sha2("payload", 256))
    long = F.col("n_bytes") >= min_revisit
    groups = rows.where(long).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where("n > 1").select("digest", "first_id"), "equal-payloads")
    n = groups.count()
    alone = F.lit(None).cast(pages.schema[id_col].dataType)
    columns = ["id", "url", "payload", "n_bytes", "digest", "refers_to"]
    if not n:
        return rows.withColumn("refers_to", alone).select(columns)
    bits, words = build_filter(groups, "digest", n)
    test = maybe(F.col("digest"), bits, words) & long
    # Without payloads: which rows of the likely groups are revisits.
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    narrow = rows.where(test).select("id", "url", "n_bytes", "digest").join(groups, "digest", "left").withColumn("refers_to", refers_to)
    narrow = materialise(narrow.drop("first_id"), "decided")
    revisits = narrow.where("refers_to is not null").withColumn("payload", F.lit(b""))
    # The others keep their payloads; rows that repeat an id and a payload are kept by one key.
    key = F.xxhash64("digest", "id")
    kept = materialise(narrow.where("refers_to is null").select("digest", "id", key.alias("key")).distinct(), "responses")
    key_bits, key_words = build_filter(kept, "key", kept.count())
    likely = rows.where(test & maybe(key, key_bits, key_words)).alias("r")
    same = (F.col("r.digest") == F.col("k.digest")) & F.col("r.id").eqNullSafe(F.col("k.id"))
    responses = likely.join(kept.alias("k"), same, "left_semi").withColumn("refers_to", alone)
    return rows.where(~test).withColumn("refers_to", alone).select(columns).unionByName(revisits.select(columns)).unionByName(responses.select(columns))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    chunk_bytes: int = CHUNK_BYTES, min_revisit: int = MIN_REVISIT,
) -> None:
    """Write one record for each row of ``pages`` as a chunked record table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays(arrays, names=["record", "chunk", "n_chunks", "bytes", "digest_so_far"])

        for batch in batches:
            for record, id_, url, payload, size_, digest, refers_to in zip(*batch.columns):
                view = memoryview(payload.as_buffer())
                for chunk in record_chunks(id_.as_py(), url.as_py(), view, size_.as_py(), digest.as_py(), refers_to.as_py(), chunk_bytes):
                    out.append((record.as_py(), *chunk))
                    size += len(chunk[2])
                    if size >= BATCH_BYTES:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    small_batches(pages.sparkSession)
    rows = decided(pages, id_col, url_col, payload_col, min_revisit)
    # A record's number tells its chunks from others; one task writes all of them.
    named = [F.col(c).cast("string").alias(c) for c in ("id", "url")]
    numbered = rows.select(
        F.monotonically_increasing_id().alias("record"), *named, "payload", "n_bytes", "digest", F.col("refers_to").cast("string").alias("refers_to")
    )
    numbered.mapInArrow(scan, TABLE).write.parquet(path)


class RecordReader:
    """Reads one record from its chunks; holds the headers only."""

    def __init__(self) -> None:
        self.pending, self.warc, self.http = b"", None, None
        self.size, self.running, self.next_chunk = 0, hashlib.sha256(), 0

    def feed(self, chunk: int, data: bytes, digest_so_far: str) -> None:
        if chunk != self.next_chunk:
            raise ValueError(f"chunk {self.next_chunk} of a record is missing")
        self.next_chunk += 1
        while self.http is None:
            self.pending += data
            data = b""
            head, found, rest = self.pending.partition(END)
            if not found:
                return
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            self.pending = rest
            if self.warc is None:
                self.warc = fields
            else:
                self.http, data, self.pending = fields, rest, b""
        left = self.expected - self.size
        part = data[:left]
        self.running.update(part)
        self.size += len(part)
        if self.running.hexdigest() != digest_so_far:
            raise ValueError("a chunk does not have the digest that its row carries")

    @property
    def expected(self) -> int:
        return int(self.http["Content-Length"]) if self.warc["WARC-Type"] == "response" else 0

    def result(self) -> tuple:
        """``(id, payload_bytes, payload_digest, record_type, refers_to)``."""
        if self.http is None or self.size != self.expected:
            raise ValueError("a record ends before its payload does")
        kind, digest = self.warc["WARC-Type"], self.warc["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and self.running.hexdigest() != digest:
            raise ValueError("a payload does not have the digest that its header states")
        return _id(self.warc.get("WARC-Record-ID")), int(self.http["Content-Length"]), digest, kind, _id(self.warc.get("WARC-Refers-To"))


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row for each record: ``id, payload_bytes, payload_digest, record_type, refers_to``; ids and
    references are cast to ``id_type``.

    Chunks of oversized records are brought together by record and read in order.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        reader, current = RecordReader(), None
        for batch in batches:
            out = []
            for record, chunk, n, data, digest in zip(*batch.columns):
                if record.as_py() != current:
                    reader, current = RecordReader(), record.as_py()
                reader.feed(chunk.as_py(), data.as_py(), digest.as_py())
                if chunk.as_py() == n.as_py() - 1:
                    out.append(reader.result())
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    table = spark.read.schema(TABLE).parquet(path)
    result = "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    small = table.where("n_chunks = 1").mapInArrow(scan, result)
    large = table.where("n_chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(scan, result)
    named = {c: F.col(c).cast(id_type) for c in ("id", "refers_to")}
    return small.unionByName(large).withColumns(named)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path, pages.schema[options.get("id_col", "page_id")].dataType.simpleString())
