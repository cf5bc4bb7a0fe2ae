"""Deterministic sharded WARC writer and its reader.

Records are cut into ranges of (key, hash of the payload) whose bounds depend on the data alone
(quantiles of the rows that a hash picks), sorted, and written range by range:
a file is closed once its compressed size reaches a target, and each range begins
a new one. Ranges hold several files: RANGE_BYTES of payload against FILE_BYTES
compressed. There are at most MAX_RANGES; of more payload than they hold at that size, ranges
and the default size of files grow alike, files up to MOST_FILE_BYTES. So the driver cuts ranges from
a bounded number of keys, and tasks and files stay few, whatever the size. Headers, digests and record ids come from the record, dates from a
parameter, and each record is a gzip member without a time, so the same table
gives the same files byte for byte, however Spark deals it out.

A task writes under a temporary name and renames a finished file to its final
name; a task that runs twice writes the same bytes twice. Files count once they
stand in the manifest, a table that Spark commits after all of them; the reader
opens what the manifest names and nothing else, and checks digests.

Of records with equal payloads (LEAST_PAYLOAD bytes at least) the one with the
largest key is a response and the others revisit it, without a payload of their
own. Copies are found over digests alone; payloads move once, to their range.

Paths are URIs that pyarrow's filesystems open: local files, HDFS, S3, GCS.

Edge cases: a null payload is an empty one; a null URL has no target header;
line ends in a URL are percent-encoded; a null key sorts first and gives way to
any other key as response, but where all equal payloads have null keys all stay
responses; of rows equal in key and payload the first is the response, if the key
is the largest, and the others revisit it; an empty table writes a manifest
without files; very long payloads are written whole, and close their file; repeated rows
are each written; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_path, small_batches

LEAST_PAYLOAD = 0
#: Compressed bytes at which a file is closed, and payload bytes of a range.
FILE_BYTES = 2 << 20
MOST_FILE_BYTES = 1 << 30
RANGE_BYTES = 32 << 20
MAX_RANGES = 1 << 14
#: Rows that are gathered to cut ranges, about, and rows of each range at least.
SAMPLED_KEYS = 20_000
SAMPLED_OF_RANGE = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
#: What a decompressor gets at once: the rest of it is handed to the next record's.
FEED_BYTES = 4 << 10
#: The place of a null key: before all others.
NO_KEY = -(1 << 63)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def record_id(key: object) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def record(key: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One record, uncompressed: a response, or a revisit where refers_to is a key."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    """The record that opens a file."""
    block = b"software: tidelog\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _header(fields) + block + b"\r\n\r\n"


def _place() -> F.Column:
    """Where a row stands in the order of ranges: its key, null first, and a hash of its payload's digest."""
    return F.struct(F.coalesce("key", F.lit(NO_KEY)).alias("k"), F.xxhash64("digest").alias("x"))


def range_bounds(rows: DataFrame, ranges: int, sampled: int = SAMPLED_KEYS) -> list[tuple[int, int]]:
    """Places that begin ranges 1 and up: quantiles of the rows whose hash is 0 modulo a number set by the rows alone."""
    if ranges < 2:
        return []
    places = rows.select(_place().alias("at")).select("at.k", "at.x")
    every = max(1, places.count() // max(sampled, SAMPLED_OF_RANGE * ranges))
    picked = places.where(F.crc32(F.concat_ws(":", "k", "x").cast("binary")) % every == 0).toArrow()
    picked = sorted(zip(picked.column("k").to_pylist(), picked.column("x").to_pylist(), strict=True))
    if not picked:
        return []
    return sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)})


def with_shard(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The rows with the number of their range: bounds up to their place, found among every step-th of them and then among step."""
    if not bounds:
        return rows.withColumn("shard", F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    kind = "array<struct<k:long,x:long>>"
    cut = rows.sparkSession.createDataFrame([(bounds[::step], bounds)], f"_coarse {kind}, _bounds {kind}")
    at = _place()
    # one row, of at most MAX_RANGES bounds
    both = rows.crossJoin(F.broadcast(cut)).withColumn("_c", F.size(F.filter("_coarse", lambda b: b <= at)))
    near = F.slice("_bounds", (F.greatest("_c", F.lit(1)) - 1) * step + 1, F.lit(step))
    fine = F.size(F.filter(near, lambda b: b <= at))
    return both.withColumn("shard", F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * step + fine)).drop("_coarse", "_bounds", "_c")


class _Writer:
    """Files of one task."""

    def __init__(self, uri: str, file_bytes: int, date: str):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.file_bytes, self.date, self.attempt = file_bytes, date, uuid.uuid4().hex
        self.out, self.shard, self.part, self.done = None, None, 0, []

    def open(self) -> None:
        self.name = f"range-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.fs.create_dir(f"{self.base}/temporary", recursive=True)
        self.fs.create_dir(f"{self.base}/archives", recursive=True)
        self.held = f"{self.base}/temporary/{self.name}.{self.attempt}"
        self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.held, compression=None), 0, 0, hashlib.sha256()
        self.put(_member(info_record(self.name, self.date)))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, shard: int, body: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.out is None:
            self.open()
        self.put(_member(body))
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()
            self.part += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.held, f"{self.base}/archives/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


_MANIFEST = "name string, records long, bytes long, sha256 string"


def write_warc(
    pages: DataFrame,
    uri: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_payload: int = LEAST_PAYLOAD,
    file_bytes: int | None = None,
    range_bytes: int = RANGE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Writes all rows as archives below a URI; returns the manifest (name, records, bytes, sha256).

    file_bytes: compressed bytes at which a file is closed; by default as the table's size asks.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    total = pages.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()[0]
    needed = -(-total // range_bytes)
    file_bytes = file_bytes or min(MOST_FILE_BYTES, FILE_BYTES * max(1, -(-needed // MAX_RANGES)))
    bounds = range_bounds(rows, min(needed, MAX_RANGES))

    # copies, over keys and digests alone
    narrow = rows.where(F.octet_length("payload") >= least_payload).select("key", "digest")
    response = narrow.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    again = narrow.join(response, "digest").where("not key <=> refers_to").select("key", "digest", "refers_to").distinct()
    nothing = F.lit(None)
    tagged = rows.withColumn("refers_to", nothing.cast("long")).withColumn("tag", F.lit(1)).unionByName(
        again.select("key", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("tag"))
    )
    # one task for each range
    sharded = with_shard(tagged, bounds).repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = sharded.sortWithinPartitions("shard", "key", F.xxhash64("digest"), "digest", "tag", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(uri, file_bytes, date)
        said: tuple | None = None  # the revisit of the rows that follow
        last: tuple | None = None
        for batch in batches:
            for shard, k, u, body_, digest, refers, tag in zip(
                *(batch.column(c).to_pylist() for c in ("shard", "key", "url", "payload", "digest", "refers_to", "tag")), strict=True
            ):
                if tag == 0:
                    said = (k, digest, refers)
                    continue
                to = said[2] if said and said[:2] == (k, digest) else None
                if to is None and last == (k, digest) and k is not None and len(body_) >= least_payload:
                    to = k
                last = (k, digest)
                writer.add(shard, record(k, u, bytes(body_), to, date))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in writer.done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["name", "records", "bytes", "sha256"])

    small_batches(ordered).mapInArrow(run, _MANIFEST).write.parquet(f"{uri}/manifest")
    jvm = spark.sparkContext._jvm
    left = jvm.org.apache.hadoop.fs.Path(f"{uri}/temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each gzip member of a stream."""
    fields, held, buffer, at = zlib.decompressobj(31), [], b"", 0
    while True:
        if at >= len(buffer):
            buffer, at = stream.read(READ_BYTES), 0
            if not buffer:
                if held:
                    raise ValueError("an archive ends within a record")
                return
        fed = buffer[at : at + FEED_BYTES]
        held.append(fields.decompress(fed))
        at += len(fed) - len(fields.unused_data)
        if fields.eof:
            whole = b"".join(held)
            head, _, rest = whole.partition(b"\r\n\r\n")
            named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            named = {k.lower(): v for k, v in named.items()}
            yield named, rest[: int(named["content-length"])]
            fields, held = zlib.decompressobj(31), []


def read_warc(spark: SparkSession, uri: str, key: str = "page_id", with_payload: bool = False) -> DataFrame:
    """Responses and revisits of the archives that the manifest names.

    A response whose payload doesn't have its digest raises a ValueError.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest").select("name")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def number(text: str) -> int | None:
        inner = text.removeprefix("<urn:page:").removesuffix(">")
        return None if inner == "null" else int(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
        names = [c.strip().split()[0] for c in schema.split(",")]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/archives/{name}", compression=None) as stream:
                    for named, block in records_of(stream):
                        if named["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest = named["warc-payload-digest"].removeprefix("sha1:")
                        response = named["warc-type"] == "response"
                        if response and (base32_sha1(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: the payload of {named['warc-record-id']} does not have its digest")
                        row = (number(named["warc-record-id"]), named.get("warc-target-uri"), length, digest, named["warc-type"], None if response else number(named["warc-refers-to"]))
                        rows.append(row + ((payload,) if with_payload else ()))
                        size += len(payload) if with_payload else 0
                        if len(rows) >= 10_000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return manifest.repartition(parts).mapInArrow(run, schema).withColumnRenamed("key", key)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    uri = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """The same in DuckDB: four base32 digits from each five hex digits of the digest."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"'{alphabet}'[1 + (('0x' || substr(x, {1 + 5 * g}, 5))::BIGINT >> {shift} & 31)]" for g in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH raw AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
last AS (SELECT x, max(page_id) AS top FROM raw GROUP BY x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM raw JOIN last USING (x)
"""
