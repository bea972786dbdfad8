"""Media columns: content-addressed payloads in tar shards.

A payload is stored once in a shard as an 8-bit greyscale PNG, a lossless form with 8-bit samples; the shard is a plain
tar file whose members are named by the payload's digest. Rows carry digest, shard, offset and length. Metadata columns
come from range reads of the stored header alone, features from reading the stored bytes back.

Shards are written through pyarrow's file systems, so the shared folder may be any store that pyarrow opens. A retried
task writes new shards; only those of tasks that ended are in the index.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.session import new_path, saved

#: The row length that payloads are filled up to, and the PNG format's signature and header length.
ROW = 576
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33

SHARD_BYTES = 256 << 20
#: Stored payloads that lie side by side are read together up to this size.
READ_BYTES = 4 << 20
INDEX_SCHEMA = "doc_id {}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"


def to_payload(content: bytes) -> bytes:
    """content and bytes 255 up to a positive multiple of ROW."""
    return content + b"\xff" * (max(1, -(-len(content) // ROW)) * ROW - len(content))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """The payload's bytes as the samples of a greyscale image ROW wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES of a PNG."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png made; checks the chunks' sums."""
    width, height, depth, colour = read_header(stored[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the stored image is damaged")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not a form that encode_png writes")
    return lines[:, 1:].tobytes()


def block_hash(payload: bytes) -> str:
    """64 bits: whether each 64th of the payload is lighter than the whole. ROW is a multiple of 64."""
    means = np.frombuffer(payload, np.uint8).reshape(64, -1).mean(axis=1)
    return f"{int(np.packbits(means > means.mean()).view('>u8')[0]):016x}"


class _Shards:
    """Writes payloads to tar shards of a bounded size; add() says where one lies."""

    def __init__(self, root: str, part: int) -> None:
        self.files, self.top = fs.FileSystem.from_uri(root)
        self.part, self.out, self.at, self.n = part, None, 0, 0

    def add(self, name: str, stored: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.shard = f"shard-{self.part:06d}-{self.n:04d}-{uuid.uuid4().hex[:12]}.tar"
            self.files.create_dir(self.top, recursive=True)
            self.out, self.at, self.n = self.files.open_output_stream(f"{self.top}/{self.shard}"), 0, self.n + 1
        member = tarfile.TarInfo(f"{name}.png")
        member.size = len(stored)
        head = member.tobuf(tarfile.USTAR_FORMAT)
        offset = self.at + len(head)
        self.out.write(head + stored + b"\0" * (-len(stored) % 512))
        self.at = offset + len(stored) + (-len(stored) % 512)
        place = self.shard, offset, len(stored)
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _store(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(root, TaskContext.get().partitionId()), {}
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                content = content.as_py()
                payload = to_payload(content)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    seen[digest] = shards.add(digest, encode_png(payload))
                rows.append((len(content), len(payload), digest, *seen[digest]))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return run


def store_media(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Stores each row's payload under root; doc_id, n_bytes, payload_bytes, digest for each row, and the payloads' places.

    The places are digest, shard, offset, length, a row for each payload. A task stores equal payloads once; where several
    tasks met one, its place is the first in order and the other copies are not referred to. Null text counts as empty,
    whose payload is one row of filling.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    written = saved(rows.mapInArrow(_store(root), INDEX_SCHEMA.format(kind)), "media-index")
    place = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return written.drop("shard", "offset", "length"), place.select("digest", "place.shard", "place.offset", "place.length")


def _headers(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(root)
        shard = source = None
        for batch in batches:
            found = []
            for name, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist()):
                if name != shard:
                    shard, source = name, files.open_input_file(f"{top}/{name}")
                found.append(read_header(source.read_at(HEADER_BYTES, offset)))
            columns = [pa.array(x, pa.int32()) for x in zip(*found)] or [pa.array([], pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in HEADED_NAMES[:4]), *columns], HEADED_NAMES)

    return run


HEADED_NAMES = ["digest", "shard", "offset", "length", "width", "height", "bit_depth", "colour_type"]
HEADED_SCHEMA = "digest string, shard string, offset long, length long, width int, height int, bit_depth int, colour_type int"


def header_columns(places: DataFrame, root: str) -> DataFrame:
    """places with width, height, bit_depth, colour_type of the stored payloads, from range reads of their headers alone."""
    dealt = places.select(*HEADED_NAMES[:4]).repartition("shard").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(_headers(root), HEADED_SCHEMA)


def _spans(shards: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows that one read can serve: half-open row numbers."""
    first = 0
    for i in range(1, len(shards) + 1):
        if i == len(shards) or shards[i] != shards[first] or offsets[i] + lengths[i] - offsets[first] > READ_BYTES or offsets[i] - offsets[i - 1] - lengths[i - 1] > 65536:
            yield first, i
            first = i


def _features(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(root)
        shard = source = None
        for batch in batches:
            digests, shards, offsets, lengths = (batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))
            found = []
            for a, b in _spans(shards, offsets, lengths):
                if shards[a] != shard:
                    shard, source = shards[a], files.open_input_file(f"{top}/{shards[a]}")
                held = source.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a])
                for i in range(a, b):
                    stored = held[offsets[i] - offsets[a] : offsets[i] - offsets[a] + lengths[i]]
                    payload = decode_png(stored)
                    found.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(stored).hexdigest(), block_hash(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*found), kinds)] or [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in HEADED_NAMES), *columns], FEATURE_NAMES)

    return run


FEATURE_NAMES = [*HEADED_NAMES, "payload_sha256", "tail_crc32", "media_sha256", "feature"]
FEATURE_SCHEMA = HEADED_SCHEMA + ", payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def media_features(places: DataFrame, root: str) -> DataFrame:
    """A row for each stored payload: its place, its header columns (see header_columns: no payload is read for them), and
    then what its stored bytes, read back and decoded, give."""
    return header_columns(places, root).mapInArrow(_features(root), FEATURE_SCHEMA)


def _qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark takes it for, as pyarrow wants it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Stores the texts of docs and returns a row for each: ids, sizes, digests, feature, header columns and place.

    Equal texts have equal values in all columns but doc_id. Null and empty texts are equal. Repeated rows and repeated
    doc_ids give a row each; other columns are not looked at; an empty table gives an empty result. A text is held whole
    by one task, which the longest text must fit.
    """
    spark = docs.sparkSession
    root = _qualified(spark, root or new_path(spark, "media"))
    rows, places = store_media(docs, root)
    # A table of its own, so that the join can be split where a third of all rows have one payload.
    features = saved(media_features(places, root), "media-features")
    return rows.join(features, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256",
        "feature", "width", "height", "bit_depth", "colour_type", "shard", "offset",
    )
