"""WARC archives as a chunked record table.

Reading yields one row per (record, chunk): the bytes of at most one chunk, where it stands in the payload, and the
digest of the payload so far. Neither side holds a whole payload in Python: the writer gets chunk rows and appends
them to a compressed member, the reader streams and updates one digest per record. Records with equal payloads are
written once; the others are revisits that refer to it.

Files are written by tasks under a shared folder, each under a name of its own attempt; a manifest table, committed
by Spark, names the files that count. A task that ran twice, or was lost, leaves a file that no manifest names.

Defined results: a null payload is the empty payload; a record without id takes part (it is a response only where all
records of its payload lack one); rows that repeat both id and payload are all responses; an empty table gives none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import few
from .common import Scratch, read_table, small_batches

CHUNK_BYTES = 1 << 18
FILE_BYTES = 256 << 20
#: Repeated digests up to which they are broadcast (below 100 bytes each). Beyond, only those of HOT_ROWS records or more are (at most
#: records / HOT_ROWS); the others are joined by shuffle, where none is a hot key.
BROADCAST_ROWS, HOT_ROWS = 200_000, 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, record_type string, refers_to bigint, chunk_no bigint, chunk_offset bigint, chunk_bytes bigint, digest_so_far string, is_last boolean, payload_digest string"


def with_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, digest (hex), record_type, refers_to: of equal payloads that with the largest id is the response."""
    spark = pages.sparkSession
    payloads = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = payloads.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = scratch.table(repeated, "repeated")
    if few(repeated, BROADCAST_ROWS):
        found = payloads.join(F.broadcast(repeated), "digest", "left")
    else:
        hot = F.broadcast(repeated.filter(F.col("n") >= HOT_ROWS))
        rest = payloads.join(hot, "digest", "left_anti").join(repeated.filter(F.col("n") < HOT_ROWS), "digest", "left")
        found = payloads.join(hot, "digest").unionByName(rest)
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return found.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response_id")).alias("refers_to")
    )


def chunk_rows(records: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each payload, in order; a revisit has one row without bytes."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    named = records.select("page_id", "url", "digest", "record_type", "refers_to", body.alias("payload"))
    # only numbers are exploded; a chunk is cut out when its row is made, so no second copy of a payload is held
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("payload"), F.lit(1)) - 1) / size).cast("int"))
    rows = named.select("*", F.octet_length("payload").cast("long").alias("length"), F.explode(numbers).alias("chunk_no"))
    return rows.withColumn("chunk", F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size))).drop("payload")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    value = (name or "none").strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def header(page_id, url, digest_hex, record_type, refers_to, length) -> bytes:
    """The header block of a record."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c.isprintable()))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def write_archives(chunks: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes chunk rows, those of a record one after the other, as compressed archives below ``folder`` (a URI that
    pyarrow can open); one member per record. Lazy; yields the manifest (path, records) of what each task wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, packer, left = [], None, None, 0
        for batch in batches:
            keys = batch.select(["page_id", "url", "digest", "record_type", "refers_to", "length", "chunk_no"]).to_pylist()
            for row, chunk in zip(keys, batch.column("chunk"), strict=True):
                if row.pop("chunk_no") == 0:
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        done.append([name := f"{uuid.uuid4().hex}.warc.gz", 0])
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    left = row["length"]
                    done[-1][1] += 1
                    row["digest_hex"] = row.pop("digest")
                    out.write(packer.compress(header(**row)))
                data = chunk.as_buffer()
                out.write(packer.compress(data))
                left -= data.size
                if left == 0:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return chunks.mapInArrow(run, "path string, records bigint")


def read_records(stream, size: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of one archive: RECORDS' columns, and the chunk's bytes if asked for."""
    with gzip.GzipFile(fileobj=stream) as plain:
        while line := plain.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not the start of a record: {line[:40]!r}")
            fields = {}
            while (line := plain.readline()).strip():
                key, _, value = line.decode("utf-8").partition(":")
                fields[key.strip().lower()] = value.strip()
            length, digest = int(fields["content-length"]), hashlib.sha1()
            kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            at, chunk_no = 0, 0
            while True:
                data = plain.read(min(size, length - at))
                if len(data) < min(size, length - at):
                    raise ValueError("a record ends before its length")
                digest.update(data)
                last = at + len(data) == length
                so_far = base64.b32encode(digest.copy().digest()).decode()
                if last and kind == "response" and so_far != stated:
                    raise ValueError(f"{fields['warc-record-id']}: digest {so_far}, stated {stated}")
                yield (_id(fields["warc-record-id"]), kind, _id(fields.get("warc-refers-to")), chunk_no, at, len(data), so_far, last, stated, *([data] if with_data else []))
                at, chunk_no = at + len(data), chunk_no + 1
                if last:
                    break


def read_archives(manifest: DataFrame, size: int = CHUNK_BYTES, with_data: bool = True, rows: int = 64) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` (path) names, one file per task."""
    schema = RECORDS + ", chunk binary" * with_data
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]
    per_batch = rows if with_data else 5000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def packed(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                held = []
                with store.open_input_stream(at, compression=None) as stream:
                    for row in read_records(stream, size, with_data):
                        held.append(row)
                        if len(held) == per_batch:
                            yield packed(held)
                            held = []
                if held:
                    yield packed(held)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, schema)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    small_batches(spark)
    scratch = Scratch(spark, "warc")
    records = with_roles(read_table(spark, sf_dir, "pages"), scratch)
    manifest = scratch.table(write_archives(chunk_rows(records), f"{scratch.root}/archives"), "manifest")
    ends = scratch.table(read_archives(manifest, with_data=False).filter("is_last"), "records")
    # a revisit has the length of the response with its digest
    sizes = ends.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(F.max(F.col("chunk_offset") + F.col("chunk_bytes")).alias("payload_bytes"))
    return ends.join(sizes, F.col("payload_digest") == F.col("digest")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: op1_warc's result as SQL, from the pages alone; base32 is made of groups of five hexadecimal digits.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as hex, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), 'string_agg', '') as digest from p),
t as (select h, max(page_id) as top from p group by all)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id is not distinct from top then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to from d join t using (h)"""
