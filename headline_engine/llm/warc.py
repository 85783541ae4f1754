"""Deterministic sharded WARC writer and reader.

Writer: pages are dealt to contiguous page_id ranges (exact counts, so the same table gives the same shards) and sorted
inside; a task streams a range into gzip members, one per record, and starts a new file when the compressed size passes
`roll_bytes`. Headers and digests are regenerated from the page. A file is written under a temporary name and renamed
when it is whole; a retried or speculative task writes the same bytes under the same final name. The manifest (file,
records, bytes, SHA-256) is a table that Spark commits after all files; only files that it names belong to the archive.

Equal payloads of at least `revisit_bytes` bytes are stored once: the record with the smallest page_id is a response,
the others are revisits that refer to it. Only digests and ids are grouped; the payloads move once, to their range.

Defined cases: a null html is the empty payload, a null url leaves the target header out (line ends in a url are percent-
encoded); a null page_id sorts first and reads back as null; repeated rows of the response's id are responses too;
an empty table gives an empty manifest and no file. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    CHUNK_BYTES,
    contiguous_shards,
    NULL_ID,
    open_fs,
    parallelism,
)

ROLL_BYTES = 64 << 20
REVISIT_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, part int, file string, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, file string"
_GZIP = 16 + zlib.MAX_WBITS


def _urn(page_id: int) -> str:
    return f"<urn:page:{'none' if page_id == NULL_ID else page_id}>"


def _from_urn(urn: str) -> int | None:
    v = urn[len("<urn:page:"):-1]
    return None if v == "none" else int(v)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]  # pages carry no crawl time; a fixed one keeps files reproducible
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; raises if a digest or length does not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    n = int(h["Content-Length"])
    block, tail = rest[:n], rest[n:]
    if tail != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    response = h["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
    return {"page_id": _from_urn(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": h["WARC-Type"], "refers_to": None if response else _from_urn(h["WARC-Refers-To"]),
            "html": payload.decode() if response else None}


class _Roller:
    """Files of one range: temporary name while open, final name when whole."""

    def __init__(self, folder: str, shard: int, roll: int) -> None:
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None

    def add(self, member: bytes) -> tuple | None:
        if self.out is None:
            self.temp = f"{self.folder}/.tmp-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        return self.close() if self.size >= self.roll else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        name = f"pages-{self.shard:05d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temp, f"{self.folder}/{name}")
        row = (self.shard, self.part, name, self.records, self.size, self.sha.hexdigest())
        self.part += 1
        return row


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES, shard_rows: int = 1000) -> DataFrame:
    """Write the archive into the (shared) folder; returns its committed manifest."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.col("url"), html.cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))

    same = p.where(F.octet_length("payload") >= revisit_bytes).select("_id", "digest")
    first = same.groupBy("digest").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refs = same.join(first, "digest").where("_id <> first").select("_id", "digest", "first").distinct()

    parts = parallelism(spark)
    n = max(1, p.count() // (shard_rows * 4 * parts))
    shards = contiguous_shards(p.select("_id"), "_id", shard_rows * n)
    none = lambda t: F.lit(None).cast(t)
    rows = p.select("_id", F.lit(1).alias("kind"), "digest", none("bigint").alias("first"), "url", "payload")
    rows = rows.unionByName(refs.select("_id", F.lit(0).alias("kind"), "digest", "first", none("string").alias("url"), none("binary").alias("payload")))
    rows = rows.withColumn("shard", shards.column).repartition(parts, "shard").sortWithinPartitions("shard", "_id", "kind", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, refers = None, None, {}
        made: list[tuple] = []
        for batch in batches:
            shard, ids, kind, digest, to, url = (batch.column(k).to_pylist() for k in ("shard", "_id", "kind", "digest", "first", "url"))
            payload = batch.column("payload")
            for i in range(batch.num_rows):
                if roller is None or shard[i] != roller.shard:
                    made += [roller.close()] if roller else []
                    roller = _Roller(folder, shard[i], roll_bytes)
                if ids[i] != at:
                    at, refers = ids[i], {}
                if kind[i] == 0:
                    refers[digest[i]] = to[i]
                    continue
                rec = record(at, url[i], payload[i].as_py(), digest[i], refers.get(digest[i]))
                z = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                made.append(roller.add(z.compress(rec) + z.flush()))
        made += [roller.close()] if roller else []
        rows = [m for m in made if m]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "part", "file", "records", "bytes", "sha256"])

    # Spark's committer publishes the manifest whole or not at all.
    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def _members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream."""
    z, out, data = zlib.decompressobj(_GZIP), [], b""
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                if out:
                    raise ValueError("truncated archive")
                return
        out.append(z.decompress(data))
        if z.eof:
            data = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(_GZIP), []
        else:
            data = b""


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the files that the manifest names, checked against digests and record counts."""
    files = spark.read.parquet(f"{folder}/_manifest").select("file", "records").repartition(parallelism(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home = open_fs(folder)
        fields = [x.split() for x in _RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])

        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                seen, held, size = 0, [], 0
                with fs.open_input_stream(f"{home}/{name}", compression=None) as f:
                    for raw in _members(f):
                        row = parse(raw) | {"file": name}
                        if not payloads:
                            row["html"] = None
                        held.append(row)
                        seen += 1
                        size += len(raw)
                        if size > CHUNK_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, the manifest says {records}")
                if held:
                    yield batch_of(held)

    return files.mapInArrow(run, _RECORDS)
