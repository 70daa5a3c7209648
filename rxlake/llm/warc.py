"""Deterministic sharded WARC archives: write, commit, read back.

Writing:

1. shard bounds are quantiles of the page ids whose hash falls in a fixed
   residue class (at most ``BOUND_SAMPLE`` expected), so they depend on the
   rows alone; records go to their shard and are sorted by id there (one
   shuffle of the pages);
2. payloads are compared by length and SHA-256.  Of equal payloads of
   ``REVISIT_BYTES`` or more the record with the smallest page id is the
   response and the others are revisits of it.  Only (id, digest) rows are
   grouped and joined for that; a revisit's mark travels to the shard as a row
   of its own just before its page;
3. each shard appends one gzip member per record and rolls to the next file
   when the compressed size reaches ``roll_bytes``.  Dates, record ids and gzip
   headers are fixed functions of the record, so a repeated or speculative task
   writes the same bytes.  A file is written under a temporary name and then
   renamed;
4. the names, sizes and SHA-256 of all files are written as the manifest, by
   Spark, after every shard is done.  Readers take only files that the manifest
   lists, and check them against it.

Defined results: a null html is an empty payload; a null url is an empty
target; pages with a null id get no id header, and are revisits if another
record with an id has their payload; repeated rows of the smallest id are all
responses; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rxlake.llm.store import shared_folder, written
from rxlake.session import shuffle_partitions

REVISIT_BYTES = 100
ROLL_BYTES = 16 << 20
BOUND_SAMPLE = 20_000
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")      # the URL name space of RFC 4122

MANIFEST = "file string, part int, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}|{url}|{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One response or revisit record, headers and digests regenerated."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit",
            "WARC-Record-ID": record_id(page_id, url, digest), "WARC-Date": date,
            "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
            "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
            "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "WARC-Payload-Digest": f"sha256:{digest}"}
    if page_id is not None:
        head["X-Page-Id"] = page_id
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-Id"] = refers_to
    return _framed(head, block)


def _framed(head: dict, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive file."""
    rest = memoryview(data)
    while len(rest):
        z = zlib.decompressobj(31)
        raw = z.decompress(rest)
        rest = rest[len(rest) - len(z.unused_data):] if z.unused_data else rest[:0]
        head, _, body = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        if first != "WARC/1.1" or body[size:] != b"\r\n\r\n":
            raise ValueError("broken WARC record")
        yield fields, body[:size]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Roller:
    """The files of one shard."""

    def __init__(self, folder: str, part: int, roll_bytes: int, date: str):
        self.store, self.path = _open(folder)
        self.part, self.roll, self.date = part, roll_bytes, date
        self.number, self.done = 0, []
        self._new()

    def _new(self) -> None:
        info = b"software: rxlake\r\nformat: WARC File Format 1.1\r\n"
        name = f"shard-{self.part:05d}-{self.number:05d}.warc.gz"
        self.name, self.count, self.ids = name, 0, []
        self.data = [member(_framed({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>",
                                     "WARC-Date": self.date, "WARC-Filename": name, "Content-Type": "application/warc-fields",
                                     "Content-Length": len(info)}, info))]
        self.size = len(self.data[0])

    def add(self, page_id: int | None, data: bytes) -> None:
        self.data.append(member(data))
        self.size += len(self.data[-1])
        self.count += 1
        self.ids += [page_id] if page_id is not None else []
        if self.size >= self.roll:
            self.close()
            self._new()

    def close(self) -> None:
        if not self.count:
            return
        data = b"".join(self.data)
        at = TaskContext.get()
        temporary = f"{self.path}/.{self.name}.{at.taskAttemptId()}.tmp"
        self.store.create_dir(self.path, recursive=True)
        with self.store.open_output_stream(temporary) as out:
            out.write(data)
        self.store.move(temporary, f"{self.path}/{self.name}")
        self.done.append((self.name, self.part, self.count, len(data), hashlib.sha256(data).hexdigest(),
                          min(self.ids, default=None), max(self.ids, default=None)))
        self.number += 1


def shard_bounds(ids: DataFrame, shards: int) -> list[int]:
    """Ascending first ids of shards 1.. from a hash sample of the ids."""
    n = ids.count()
    every = max(1, -(-n // BOUND_SAMPLE))
    sample = np.sort([r.id for r in ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).collect()])
    if not len(sample):
        return []
    return sorted({int(sample[len(sample) * i // shards]) for i in range(1, shards)})


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
          shards: int | None = None, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> None:
    """Writes the archives below ``folder`` (a URI that driver and executors share) and their manifest."""
    spark = pages.sparkSession
    shards = shards or shuffle_partitions(spark)
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"),
                     body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = p.where(F.octet_length("payload") >= REVISIT_BYTES).select("id", "digest")
    narrow = written(narrow, "warc-digests")
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    marks = narrow.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first"))) \
        .select("id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first").distinct()
    bounds = shard_bounds(p.select("id"), shards)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.coalesce("id", F.lit(-(1 << 63))))) if bounds else F.lit(0)
    rows = p.withColumn("first", F.lit(None).cast("long")).unionByName(marks).withColumn("part", part)
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(
        "part", F.asc_nulls_first("id"), "digest", F.asc_nulls_first("payload"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mark = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row_id, page, payload, digest, refers, shard = (batch.column(c)[i] for c in range(6))
                key = (row_id.as_py(), digest.as_py())
                if not payload.is_valid:
                    mark = (key, refers.as_py())
                    continue
                if out is None or out.part != shard.as_py():
                    if out is not None:
                        out.close()
                    out, before = _Roller(f"{folder}/data", shard.as_py(), roll_bytes, date), out
                    out.done = before.done if before is not None else []
                refers_to = mark[1] if mark is not None and mark[0] == key else None
                out.add(key[0], record(key[0], page.as_py(), payload.as_py(), key[1], refers_to, date))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out.done), (
                pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["file", "part", "records", "bytes", "sha256", "first_id", "last_id"])

    rows.select("id", "url", "payload", "digest", "first", "part").mapInArrow(run, MANIFEST) \
        .write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files that the manifest lists.

    Columns: page_id, url, record_type, payload_bytes, payload_digest (both of
    the full payload), refers_to, payload (null for revisits), file.
    """
    listed = spark.read.parquet(f"{folder}/manifest")
    columns = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, " \
              "refers_to bigint, payload binary, file string"
    if listed.isEmpty():
        return spark.createDataFrame([], columns)
    files = spark.read.format("binaryFile").load(f"{folder}/data").withColumn("file", F.element_at(F.split("path", "/"), -1))
    files = files.join(listed.select("file", "bytes", "sha256"), "file")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file, content, sha in zip(*(batch.column(c) for c in ("file", "content", "sha256"))):
                data = content.as_buffer()
                if hashlib.sha256(data).hexdigest() != sha.as_py():
                    raise ValueError(f"{file} differs from the manifest")
                rows, size = [], 0
                for head, block in records(data):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = head["WARC-Type"] == "response"
                    if whole and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"{file}: payload differs from its digest")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], length, digest,
                                 int(refers) if refers else None, payload if whole else None, file.as_py()))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("file", "content", "sha256").mapInArrow(run, columns)


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns, from the archives."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)
"""
