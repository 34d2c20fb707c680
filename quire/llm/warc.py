"""Deterministic sharded WARC writer and reader.

Rows are parted by page_id ranges and sorted, so that the same table gives the same archives byte for byte.
Each task writes its range as gzip members, one a record, and rolls to a new file once the compressed size
passes ROLL_BYTES. A file is written under an attempt's own temporary name and renamed when it is whole; the
manifest (a table beside the archives: file, records, first and last id, bytes, SHA-256) is written last, and
readers take only the files it names. A lost or repeated task rewrites the same bytes under the same name.

Of pages with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a response
and the others revisit it. Headers, digests and lengths are made anew for every record.

Defined cases: null html is an empty payload; a null url is written as an empty target; all rows of the
smallest page_id of a payload are responses (repeated rows included); a null page_id is kept, never counts
as the smallest while another id has the payload, and then revisits it. An empty table writes an empty
manifest and reads back as no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bucket_of, id_bounds, partitions, small

MIN_REVISIT = 100
ROLL_BYTES = 16 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "manifest"
MANIFEST_FIELDS = "file string, records bigint, first_id bigint, last_id bigint, bytes bigint, sha256 string"
RECORD_FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, file string"


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    told = value.strip("<>").rpartition(":")[2]
    return None if told == "none" else int(told)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, headers and all; a revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", json.dumps(url, ensure_ascii=True)[1:-1]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        headers[1:1] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    view, place, step = memoryview(data), 0, 1 << 16
    while place < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            fed = view[place : place + step]
            if not fed:
                raise ValueError("a record is cut short")
            parts.append(unpacker.decompress(fed))
            place += len(fed)
        place -= len(unpacker.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
    return headers, block


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit: what will be written, in no order."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    shared = own.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = small(shared)
    # Beyond the broadcast the adaptive join splits a digest that very many pages share.
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return own.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives of pages and their manifest into folder; the manifest as a DataFrame."""
    spark = pages.sparkSession
    n = partitions(spark)
    bounds = id_bounds(pages.select(F.col("page_id").cast("long").alias("page_id")), "page_id", n)
    records = plan_records(pages).withColumn("bucket", bucket_of("page_id", bounds))
    dealt = records.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "url").drop("bucket")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage(folder)
        task = TaskContext.get()
        own = f"{root}/_temporary/{task.taskAttemptId()}"
        k, out, temp, size, n, first, last, seen = 0, None, "", 0, 0, None, None, None

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{task.partitionId():06d}-{k:05d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            row = {"file": name, "records": n, "first_id": first, "last_id": last, "bytes": size, "sha256": seen.hexdigest()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

        for batch in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                if out is None:
                    fs.create_dir(own, recursive=True)
                    temp = f"{own}/{k:05d}"
                    out, size, n, first, seen = fs.open_output_stream(temp, compression=None), 0, 0, page_id, hashlib.sha256()
                packed = member(record(page_id, url, payload.encode(), digest, refers_to, revisit))
                out.write(packed)
                seen.update(packed)
                size, n, last = size + len(packed), n + 1, page_id
                if size >= roll_bytes:
                    yield close()
                    k, out = k + 1, None
        if out is not None:
            yield close()

    dealt.mapInArrow(run, MANIFEST_FIELDS).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    fs, root = storage(folder)
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST_FIELDS).parquet(f"{folder}/{MANIFEST}")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives that folder's manifest names, checked against its digests.

    A file is one row of the binary source and at most about ROLL_BYTES long; its records leave in small batches.
    """
    named = read_manifest(spark, folder).select("file", F.col("sha256").alias("told"), F.col("records").alias("told_records"))
    if named.limit(1).count() == 0:
        return spark.createDataFrame([], RECORD_FIELDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    files = files.join(small(named), "file")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string())])
        for batch in batches:
            for name, content, told, told_records in zip(*(batch.column(c) for c in ("file", "content", "told", "told_records")), strict=True):
                data, rows, held, n = content.as_py(), [], 0, 0
                if hashlib.sha256(data).hexdigest() != told.as_py():
                    raise ValueError(f"{name} differs from its manifest")
                for unpacked in members(data):
                    headers, block = parse(unpacked)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, revisit = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {headers['WARC-Record-ID']} differs")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    rows.append({"page_id": page_of(headers["WARC-Record-ID"]), "url": json.loads(f'"{headers["WARC-Target-URI"]}"'), "payload_bytes": length, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": page_of(headers["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload, "file": name.as_py()})
                    n, held = n + 1, held + len(payload)
                    if held > 1 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                if n != told_records.as_py():
                    raise ValueError(f"{name} has {n} records")

    return files.mapInArrow(run, RECORD_FIELDS)
