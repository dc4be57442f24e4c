"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by page id over ranges, and each range is written as a run of files, one
gzip member per record, a new file once the compressed size is reached. Headers, ids and
digests are made anew from the record, so the same table gives the same bytes.

Tasks write under names of their own attempt; the commit renames what the attempts that
counted have written, and the manifest comes last. A reader believes the manifest only, so
files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.session import shared_folder

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 32 << 20
#: The date of every record: the table has none, and the time of writing would differ from run to run.
DATE = "1970-01-01T00:00:00Z"
#: Parts into which rows with one payload are dealt when they look up its response.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if re.match(r"^[a-z][a-z0-9+.-]+:/", path):
        return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return arrow_fs.LocalFileSystem(), path


ORDER = ["page_id", "url", "digest"]


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, bytes, digest (hexadecimal SHA-1) of every row; a null payload is an empty one."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    return rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, digest and first (the response's page_id) of the rows of ``records`` that revisit another.

    Of rows with equal payloads of at least ``min_bytes`` that with the largest page_id is
    the response, and so are rows with that same id; a row with a null id revisits nothing.
    Payloads are not moved. A payload's rows are dealt over SALTS parts for the look-up.
    """
    rows = rows.where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes)).select(*ORDER)
    repeated = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return rows.join(repeated, ["digest", "salt"]).where("page_id <> first").select(*ORDER, "first").distinct()


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(page_id, url, payload: bytes, size: int, digest: str, first) -> bytes:
    """One WARC record. The payload of a revisit is left out; its HTTP header still tells its length."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda i: f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{i}/{sha1}'.encode()).digest()[:16], version=5)}>"
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_clean(url) if url is not None else 'urn:page:' + str(page_id)}"]
    if first is not None:
        head += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {PROFILE}", f"Refers-To-Page: {first}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    head += [f"Page: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


MANIFEST = "part int, number int, temporary string, name string, records long, bytes long, sha256 string, first_page string, last_page string"


def write_warc(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes a record per row of ``pages``, sorted by page id; returns the folder.

    Null ids come first, equal ids in the order of url and digest. The folder holds
    ``part-P-N.warc.gz`` and ``manifest`` (a row per file). Texts move once, to their range.
    """
    spark = pages.sparkSession
    folder = (folder or shared_folder(spark, "warc")).rstrip("/")
    rows = records(pages, key, url, html)
    marks = revisits(rows, min_bytes).select(*ORDER, F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("bytes"), "first")
    rows = marks.union(rows.select(*ORDER, "payload", "bytes", F.lit(None).cast("long").alias("first")))
    # A mark comes just before the rows that it says are revisits.
    by = [F.col(c).asc_nulls_first() for c in ORDER]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by, F.col("first").isNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = open_folder(folder)
        system.create_dir(f"{path}/temporary", recursive=True)
        done, out, stats, mark = [], None, {}, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append(stats | {"sha256": stats["sha256"].hexdigest()})
                out = None

        for batch in batches:
            for at in range(batch.num_rows):
                page, url, digest, payload, size, first = [c[at].as_py() for c in batch.columns]
                if first is not None:
                    mark = (page, url, digest, first)
                    continue
                first = mark[3] if mark and mark[:3] == (page, url, digest) else None
                record = _record(page, url, payload, size, digest, first)
                if out is None:
                    stats = {"part": task.partitionId(), "number": len(done), "records": 0, "bytes": 0, "sha256": hashlib.sha256(), "first_page": str(page)}
                    stats["temporary"] = f"temporary/{task.partitionId()}-{len(done)}-{uuid.uuid4().hex}"
                    stats["name"] = f"part-{task.partitionId():06d}-{len(done):05d}.warc.gz"
                    out = system.open_output_stream(f"{path}/{stats['temporary']}", compression=None)
                out.write(record)
                stats["sha256"].update(record)
                stats |= {"records": stats["records"] + 1, "bytes": stats["bytes"] + len(record), "last_page": str(page)}
                if stats["bytes"] >= roll_bytes:
                    close()
        close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        kinds = [types[x.split()[1]] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in done], k) for n, k in zip(names, kinds, strict=True)], names=names)

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/staged")  # the files of attempts that counted
    commit(spark, folder)
    return folder


def commit(spark: SparkSession, folder: str) -> None:
    """Gives the staged files their names, then writes the manifest. Can be run again after a failure."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                target, source = f"{path}/{row['name']}", f"{path}/{row['temporary']}"
                there, here = system.get_file_info([target, source])
                if here.type == arrow_fs.FileType.File:
                    system.move(source, target)
                elif there.size != row["bytes"]:
                    raise OSError(f"{target} is neither staged nor whole")
            yield batch

    spark.read.schema(MANIFEST).parquet(f"{folder}/staged").mapInArrow(rename, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one at a time."""
    rest = b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        unpack, parts = zlib.decompressobj(31), []
        while data:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                break
            data = stream.read(1 << 20)
        if not unpack.eof:
            raise OSError("the file ends within a record")
        rest = unpack.unused_data
        yield b"".join(parts)


RECORD = "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, file string"


def parse(record: bytes) -> dict:
    """Fields of one WARC record. The digest of a response is taken from its payload and must agree with its header."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise OSError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": fields["Page"] or None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("Refers-To-Page"),
    }


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the files in the manifest, read one record at a time; files are read in parallel."""
    folder = folder.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
        kinds = [types[x.split()[1]] for x in RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        rows.append(parse(record) | {"file": name} | ({} if payloads else {"payload": None}))
                        held, seen = held + len(rows[-1]["payload"] or b""), seen + 1
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != records:
                    raise OSError(f"{name} has {seen} records, its manifest says {records}")
                yield batch_of(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name", "records")
    tasks = files.count()
    return files.repartition(min(max(tasks, 1), 10_000), "name").mapInArrow(read, RECORD)
