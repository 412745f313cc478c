"""WARC archives as seekable Zstandard bundles.

A bundle is a byte string in Zstandard's seekable format: WARC records are
grouped into independent frames, a skippable frame maps record identifiers to
(frame, offset within the decompressed frame), and a seek table closes the
bundle, so that one record is read by decompressing one frame. Bundles are
binary values of a table with one row each: Spark's own writers and commit
protocol store them wherever Spark can write, and a lost task is written anew.

Defined results: a null payload is an empty one, a null URL an empty one; an
empty table gives no bundle. Records with equal payloads of at least
``min_dedup_bytes`` bytes become one response, that with the smallest id, and
revisits of it. A row with a null id has a record without a number, which comes after all others and
can't be looked up or referred to. Rows that repeat an id have a record each; with equal
payloads they are of one kind. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import shared_path, slices, table, text_column
from colligate.llm.graph import with_first

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
MIN_DEDUP_BYTES = 100

# Fixed values of the seekable format and of WARC 1.1.
SEEK_TABLE_MAGIC, SEEKABLE_MAGIC, RECORD_MAP_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
RECORD_ID, NO_ID, WARC_DATE = "<urn:page:%d>", "<urn:page:>", "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = "bundle_id string, n_records long, content binary"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle_id string, frame int, frame_offset long, payload binary"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the digest and length of what it stands for."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {NO_ID if page_id is None else RECORD_ID % page_id}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {RECORD_ID % refers_to}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: its fields, its block, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its Content-Length says")
    return fields, data[start:stop], stop + 4


class Bundle:
    """Builds one bundle, record by record."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.frame_bytes, self.out, self.sizes, self.where = frame_bytes, [], [], []
        self.frame, self.filled, self.total = [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, page_id: int | None, data: bytes) -> None:
        self.where.append((page_id, len(self.sizes), self.filled))
        self.frame.append(data)
        self.filled += len(data)
        self.total += len(data)
        if self.filled >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.out.append(packed)
            self.sizes.append((len(packed), self.filled))
            self.frame, self.filled = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        ids = self.zstd.compress(json.dumps(self.where).encode())
        seek = b"".join(struct.pack("<II", *x) for x in [*self.sizes, (len(ids) + 8, 0)])
        seek += struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE_MAGIC)
        return b"".join([*self.out, struct.pack("<II", RECORD_MAP_MAGIC, len(ids)), ids, struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)), seek])


class Reader:
    """Random access to one bundle."""

    def __init__(self, content: bytes) -> None:
        n, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        at = len(content) - 9 - 8 * n
        self.content, self.frames, pos = content, [], 0
        for packed, size in struct.iter_unpack("<II", content[at:-9]):
            self.frames.append((pos, packed, size))
            pos += packed
        pos, packed, _ = self.frames.pop()  # the record map
        self.zstd = zstandard.ZstdDecompressor()
        self.where = {i: (frame, off) for i, frame, off in json.loads(self.zstd.decompress(content[pos + 8 : pos + packed]))}

    def frame(self, k: int) -> bytes:
        pos, packed, size = self.frames[k]
        return self.zstd.decompress(self.content[pos : pos + packed], max_output_size=size)

    def read(self, page_id: int) -> tuple[dict[str, str], bytes]:
        k, at = self.where[page_id]
        fields, block, _ = parse(self.frame(k), at)
        return fields, block


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup_bytes: int = MIN_DEDUP_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes a WARC record per row into bundles of about ``bundle_bytes`` at ``path``."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), text_column(url_col).alias("url"), text_column(payload_col).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = src.select("page_id", "digest", F.octet_length("payload").alias("n"))
    repeats = with_first(ids, F.col("digest"), F.col("page_id"), F.col("n") >= min_dedup_bytes)
    repeats = repeats.filter("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    rows = src.join(repeats, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(b: Bundle) -> pa.RecordBatch:
            content = b.finish()
            name = hashlib.sha256(content).hexdigest()
            return pa.RecordBatch.from_pydict({"bundle_id": [name], "n_records": pa.array([len(b.where)], pa.int64()), "content": pa.array([content], pa.binary())})

        bundle = Bundle(frame_bytes)
        for part in slices(batches, "payload"):
            for page_id, url, payload, digest, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                one_line = url.replace("\r", "%0D").replace("\n", "%0A")
                bundle.add(page_id, record(page_id, one_line, payload.encode(), digest, first))
                if bundle.total >= bundle_bytes:
                    yield ended(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.where:
            yield ended(bundle)

    rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(build, BUNDLE_SCHEMA).write.parquet(path)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the bundles, with its place in them. The digest and
    the length of a response are computed from the payload that was read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("payload", pa.binary())])
        number = lambda x: None if x == NO_ID else int(x[len("<urn:page:") : -1])
        for batch in batches:
            for name, content in zip(batch.column("bundle_id").to_pylist(), batch.column("content"), strict=True):
                reader = Reader(content.as_py())
                for k in range(len(reader.frames)):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        fields, block, after = parse(data, at)
                        kind = fields["WARC-Type"]
                        if kind == "response":
                            found = hashlib.sha256(block).hexdigest()
                            if f"sha256:{found}" != fields["WARC-Payload-Digest"]:
                                raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                            rest = (len(block), found, kind, None)
                        else:
                            rest = (int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][7:], kind, number(fields["WARC-Refers-To"]))
                        rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], *rest, name, k, at, block if payloads else None))
                        at = after
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = bundles.select("bundle_id", "content").mapInArrow(read, RECORD_SCHEMA)
    return out if payloads else out.drop("payload")


def lookup(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records with the ids in ``wanted.page_id``, each read by decompressing
    only its frame: (page_id, record_type, payload)."""
    index = bundles.select("bundle_id", "content").mapInArrow(_ids, "bundle_id string, page_id long")
    ask = index.join(wanted.select("page_id").distinct(), "page_id").groupBy("bundle_id").agg(F.collect_list("page_id").alias("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, content in zip(batch.column("ids").to_pylist(), batch.column("content"), strict=True):
                reader = Reader(content.as_py())
                got = [(i, *reader.read(i)) for i in ids]
                yield pa.RecordBatch.from_pydict({"page_id": pa.array([g[0] for g in got], pa.int64()), "record_type": [g[1]["WARC-Type"] for g in got], "payload": pa.array([g[2] for g in got], pa.binary())})

    return bundles.join(ask, "bundle_id").select("ids", "content").mapInArrow(read, "page_id long, record_type string, payload binary")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("bundle_id").to_pylist(), batch.column("content"), strict=True):
            ids = [i for i in Reader(content.as_py()).where if i is not None]
            yield pa.RecordBatch.from_pydict({"bundle_id": [name] * len(ids), "page_id": pa.array(ids, pa.int64())})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), path)
    bundles = spark.read.schema(BUNDLE_SCHEMA).parquet(path)
    return read_bundles(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, coalesce(html, '') as t from pages
), q as (
  select page_id, octet_length(encode(t)) as payload_bytes, sha256(t) as payload_digest,
         min(page_id) over (partition by t) as f
  from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and f is distinct from page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and f is distinct from page_id then f end as refers_to
from q
"""
