"""Media columns: content-addressed payloads in tar shards.

``pack`` writes payloads as 8-bit grey PNG images into tar shards in the shared folder; its rows carry
digest, shard, offset and length. Within a shard a payload is stored once. ``locate`` gives each digest one
place among all shards. ``probe`` fills metadata columns from range reads of image headers alone;
``read_back`` reads whole images and derives features from the samples.

Shards close at SHARD_BYTES or SHARD_REFS, so a task's table of digests is bounded however often one
payload occurs. A retried task writes a shard of a new name; rows name only shards that were closed.
Nulls and empty texts become one unit of filling; a text of any length is one payload; rows without an id
keep their payload under a null id; repeated rows, and rows that repeat an id, are references to their payloads,
one each; of equal payloads in several shards the first by shard and offset is read; an empty table gives an
empty table; other columns are not used. Shards need a folder that pyarrow's file systems open (local, hdfs,
s3, gs, abfs, and Hadoop's names for these); another scheme raises before anything is written.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, fresh_path, materialize

UNIT = 576
FILL = 255
SHARD_BYTES = 64 << 20
SHARD_REFS = 200_000
TASK_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, width: int = UNIT) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type, from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no image header here")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    """Samples of an 8-bit grey image that to_png wrote (no filters between lines)."""
    width, height, depth, colour = png_header(image[:HEADER_BYTES])
    if (depth, colour) != (8, 0):
        raise ValueError("8-bit grey images only")
    at, data = HEADER_BYTES, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data += image[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't expected")
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """An average hash: 64 equal stretches of samples, each bit says whether its mean exceeds the whole mean."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    means = x.reshape(64, -1).mean(axis=1)
    bits = int("".join("1" if m > x.mean() else "0" for m in means), 2)
    return f"{bits:016x}-{int(np.floor(x.mean() * 100)):05d}"


#: Hadoop's names of schemes, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _opened(uri: str) -> tuple:
    """pyarrow's file system for a path as Hadoop writes it, and the path in it."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition(":")
    if colon and "/" not in scheme:
        uri = f"{SCHEMES.get(scheme, scheme)}:{rest}"
        if scheme == "file" and not rest.startswith("//"):
            uri = f"file://{rest}"
    return FileSystem.from_uri(uri)


class _Shard:
    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.tar"
        fs, path = _opened(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.refs, self.n = fs.open_output_stream(path), 0, {}, 0

    def add(self, doc_id: object, text: str | None) -> None:
        n, payload = payload_of(text)
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.refs:
            image = to_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512))
            self.refs[digest] = (self.at + 512, len(image), n, [])
            self.at += 512 + len(image) + -len(image) % 512
        self.refs[digest][3].append(doc_id)
        self.n += 1

    def close(self, kind: pa.DataType) -> pa.RecordBatch:
        self.out.write(bytes(1024))
        self.out.close()
        place = list(self.refs.values())
        columns = [pa.array([self.name] * len(place)), pa.array(list(self.refs)), *(pa.array([p[i] for p in place], pa.int64()) for i in range(3)), pa.array([p[3] for p in place], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "digest", "offset", "length", "n_bytes", "refs"])


def pack(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, digest, offset, length, n_bytes, refs): one row for each payload in each shard, with the ids that refer to it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    shard = shard or _Shard(folder)
                    shard.add(i, t)
                    if shard.at >= SHARD_BYTES or shard.n >= SHARD_REFS:
                        yield shard.close(batch.schema.field(0).type)
                        shard = None
        if shard:
            yield shard.close(batch.schema.field(0).type)

    return rows.mapInArrow(run, f"shard string, digest string, offset long, length long, n_bytes long, refs array<{kind}>")


def locate(packed: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): of several copies the first by shard and offset."""
    return packed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(places: DataFrame, schema: str, made: object, whole: bool, tasks: int) -> DataFrame:
    """Tasks take ranges of shards and read them in order of offset; they are as many as the bytes to read ask for, not as the rows do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    fs, path = _opened(shard)
                    name, file = shard, fs.open_input_file(path)
                rows.append((digest, *made(file.read_at(length if whole else HEADER_BYTES, offset))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    at = places.select("digest", "shard", "offset", "length")
    return at.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def _tasks(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def probe(places: DataFrame, tasks: int = 32) -> DataFrame:
    """(digest, width, height, depth, colour) from headers alone."""
    return _ranges(places, "digest string, width long, height long, depth long, colour long", png_header, whole=False, tasks=tasks)


def _measured(image: bytes) -> tuple:
    samples = from_png(image)
    return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples))


def read_back(places: DataFrame, tasks: int = 32) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored bytes."""
    return _ranges(places, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _measured, whole=True, tasks=tasks)


def media_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its place, the header's metadata and what was read back."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = fresh_path(spark, "media")
    packed = materialize(pack(docs, folder, doc_id, text), "media-index")
    places = locate(packed)
    # Range reads of headers are small, but each costs a request: as many tasks as for the whole.
    tasks = _tasks(spark, places.agg(F.sum("length")).first()[0] or 0)
    facts = places.join(probe(places, tasks), "digest").join(read_back(places, tasks), "digest")
    return packed.select("digest", "n_bytes", "refs").join(facts, "digest").withColumn("doc_id", F.explode("refs")).drop("refs")
