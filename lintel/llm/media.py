"""Media columns: content-addressed payloads in tar shards.

store() writes each payload once per shard, named by its SHA-256, and returns rows that carry digest,
shard, offset and length, never the bytes. probe() fills metadata columns with range reads of the header
only. fetch() reads whole payloads by range, one read for each stored form, shards in order.

The payloads here are 8-bit grey PNG images of 192 columns, compressed without loss. Shards live in the
folder that all executors share and are opened through pyarrow's file systems, so any URI they know works.
A task that is repeated writes new shards under new names; rows point only at shards of attempts that
ended, so lost executors leave at most unused files.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.session import prepare, shared_dir, widened, written

WIDTH = 192
HEADER = 33  # signature and IHDR
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SHARD_BYTES = 64 << 20
BLOCK = 512  # of tar
TASK_BYTES = 16 << 20  # read by one task


def padded(data: bytes) -> bytes:
    """Bytes 32 are appended up to a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def png(payload: bytes) -> bytes:
    """An 8-bit grey image, a row for each WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def png_payload(data: bytes) -> bytes:
    """The samples of an image that png() wrote; every chunk's checksum is verified."""
    width, height, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered row")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 64-bit difference hash of an 8 x 9 thumbnail, as text."""
    grey = np.frombuffer(payload, np.uint8)
    cuts = np.linspace(0, len(grey), 73).astype(int)[:-1]
    cells = np.add.reduceat(grey.astype(np.int64), cuts) // np.diff(np.append(cuts, len(grey)))
    cells = cells.reshape(8, 9)
    bits = "".join("1" if x else "0" for x in (cells[:, 1:] > cells[:, :-1]).ravel())
    total, squares = int(grey.sum(dtype=np.int64)), int((grey.astype(np.int64) ** 2).sum())
    mean = total / len(grey)
    return f"{mean:.4f}:{max(0.0, squares / len(grey) - mean * mean) ** 0.5:.4f}:{int(bits, 2):016x}"


class Shards:
    """Tar shards of one task; add() returns where a member's bytes are."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.out, self.at, self.name = None, 0, ""
        self.places: dict[str, tuple[str, int, int]] = {}

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if digest in self.places:
            return self.places[digest]
        if self.out is None:
            self.name, self.at, self.places = f"shard-{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        fill = b"\0" * (-len(data) % BLOCK)
        self.out.write(head + data + fill)
        place = (self.name, self.at + len(head), len(data))
        self.places[digest] = place
        self.at += len(head) + len(data) + len(fill)
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * BLOCK * 2)
            self.out.close()
            self.out, self.places = None, {}


def store(df: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """One row per input row: key, n_bytes, digest, shard, shard_offset, shard_length. Written once, to the shared folder.

    A null text counts as empty. Equal payloads have equal digests and stored forms; a payload that several
    shards hold is addressed in the first of them, by name and offset."""
    rows, places = stored(df, key, text, folder)
    return rows.join(places, "digest").select("key", "n_bytes", "digest", "shard", "shard_offset", "shard_length").withColumnRenamed("key", key)


def stored(df: DataFrame, key: str, text: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(key, n_bytes, digest) of every row, and (digest, shard, shard_offset, shard_length) of every stored form."""
    prepare(df.sparkSession)
    schema = widened(df.select(F.col(key).alias("key")), "n_bytes long, digest string, shard string, shard_offset long, shard_length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        made: dict[str, str] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                rows = []
                for t in b.column(1).to_pylist():
                    data = (t or "").encode()
                    payload = padded(data)
                    raw = hashlib.sha256(payload).hexdigest()
                    digest = made.get(raw)
                    if digest is None or digest not in shards.places:
                        image = png(payload)
                        digest = hashlib.sha256(image).hexdigest()
                        if len(made) > 100_000:
                            made.clear()
                        made[raw] = digest
                        rows.append((len(data), digest, *shards.add(digest, image)))
                    else:
                        rows.append((len(data), digest, *shards.places[digest]))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)
        shards.close()

    rows = written(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema), "media-index")
    # written, so that a join with it reads two tables and the rows of a frequent payload can be split among tasks
    first = written(rows.groupBy("digest").agg(F.min(F.struct("shard", "shard_offset", "shard_length")).alias("place")), "media-places")
    return rows.select("key", "n_bytes", "digest"), first.select("digest", "place.*")


def places_of(rows: DataFrame) -> DataFrame:
    """(digest, shard, shard_offset, shard_length), once for each stored form."""
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "shard_offset", "shard_length")).alias("place"))
    return written(first.select("digest", "place.*"), "media-places")


def ranges(places: DataFrame, folder: str, read, schema: str) -> DataFrame:
    """Append read(length, at) to each stored form (digest, shard, shard_offset, shard_length); at(start, size) reads a range of it. Shards are read in order."""
    prepare(places.sparkSession)
    kept = ["digest", "shard", "shard_offset", "shard_length"]
    # dealt by what is to be read, not by the size of these rows
    total = places.agg(F.sum("shard_length")).first()[0] or 0
    dealt = places.select(*kept).repartitionByRange(max(1, -(-total // TASK_BYTES)), "shard", "shard_offset")
    out_schema = widened(places.select(*kept), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        now, source = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(start, 256).to_pylist():
                    if r["shard"] != now:
                        if source is not None:
                            source.close()
                        now, source = r["shard"], files.open_input_file(f"{root}/{r['shard']}")
                    offset, length = r["shard_offset"], r["shard_length"]
                    out.append((*(r[c] for c in kept), *read(length, lambda at, size, o=offset: source.read_at(size, o + at))))
                arrow = {"long": pa.int64(), "string": pa.string(), "bigint": pa.int64()}
                kinds = [arrow[f.dataType.simpleString()] for f in out_schema.fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=out_schema.names)
        if source is not None:
            source.close()

    return dealt.sortWithinPartitions("shard", "shard_offset").mapInArrow(run, out_schema)


def read_header(length: int, at) -> tuple:
    width, height, bits = png_header(at(0, HEADER))
    return width, height, bits


def read_whole(length: int, at) -> tuple:
    data = at(0, length)
    payload = png_payload(data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)


HEADER_COLUMNS = "width long, height long, bits long"
WHOLE_COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def probe(rows: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bits) from header-only range reads."""
    return ranges(places_of(rows), folder, read_header, HEADER_COLUMNS).drop("shard", "shard_offset", "shard_length")


def fetch(rows: DataFrame, folder: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back from the shards."""
    return ranges(places_of(rows), folder, read_whole, WHOLE_COLUMNS).drop("shard", "shard_offset", "shard_length")


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, then fill metadata (a header read) and features (a whole read) of each stored form: one row per input row.

    Other columns of df, whatever their names, are not read; a key that is named like an output column raises."""
    new = [c.split()[0] for c in f"n_bytes long, digest string, shard string, shard_offset long, shard_length long, {HEADER_COLUMNS}, {WHOLE_COLUMNS}".split(", ")]
    if key in new:
        raise ValueError(f"the key column {key} is named like an output column")
    folder = f"{shared_dir(df.sparkSession)}/media-{uuid.uuid4().hex}"
    rows, places = stored(df, key, text, folder)
    both = ranges(places, folder, lambda length, at: (*read_header(length, at), *read_whole(length, at)), f"{HEADER_COLUMNS}, {WHOLE_COLUMNS}")
    # written, so that the join reads two tables and the rows of a frequent payload can be split among tasks
    return rows.withColumnRenamed("key", key).join(written(both, "media-features"), "digest")


def open_tar(data: bytes) -> dict[str, bytes]:
    """Members of a shard, by name: shards are plain tar files."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}
