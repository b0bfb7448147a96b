"""Members of ZIP archives as a data source: only the directory of an archive and the members that a query asks for are read.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").load("file:///data/*.zip").filter("path = 'src/a.py'")

Archives lie in any store that pyarrow reads, or behind http(s) addresses that answer range requests. An archive is split
among tasks by the compressed sizes in its directory, which each task reads for itself, so the driver lists archives
and nothing else. Filters on archive, path and language that are equalities, lists or beginnings are applied to the
directory, before any member is unpacked; with the option `text` set to false none is, and text is null."""

from __future__ import annotations

import fnmatch
import io
import itertools
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from lintel.session import prepare
from lintel.sources.files import EXTENSIONS, LARGEST_ARCHIVE

SCHEMA = "archive string, path string, language string, size long, packed long, text string, error string"
LANGUAGES = {"py": "python", "java": "java", "c": "c", "h": "c"}
SPLIT = 128 << 20  # compressed bytes of members in a task
LARGEST_MEMBER = 64 << 20
BATCH = 8 << 20  # bytes of text in a batch of rows
BUFFER = 1 << 20  # bytes that a request to a web archive asks for at least


class RangeFile(io.RawIOBase):
    """An http(s) file that is read by ranges; its size comes from the first answer."""

    def __init__(self, url: str, timeout: float = 60):
        self.url, self.timeout, self.at, self.requests = url, timeout, 0, 0
        with self.ask("bytes=0-0") as answer:
            total = answer.headers.get("Content-Range", "").rpartition("/")[2]
            if answer.status != 206 or not total.isdigit():
                raise OSError("the server does not answer range requests")
            self.size = int(total)

    def ask(self, byte_range: str):
        self.requests += 1
        return urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": byte_range}), timeout=self.timeout)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        with self.ask(f"bytes={self.at}-{self.at + n - 1}") as answer:
            data = answer.read(n)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def is_web(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def opened(path: str):
    """A seekable file of a store or an address."""
    if is_web(path):
        return io.BufferedReader(RangeFile(path), BUFFER)
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def listed(pattern: str) -> list[tuple[str, int]]:
    """(address, size) of the archives that a path names: a file, a folder's *.zip, or a pattern in the last part; addresses of the web are separated by commas, their size isn't known yet."""
    if is_web(pattern):
        return [(p.strip(), 0) for p in pattern.split(",")]
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(pattern) if "://" in pattern else (fs.LocalFileSystem(), pattern)
    head = pattern[: len(pattern) - len(place)] if "://" in pattern else ""
    folder, _, last = place.rpartition("/")
    if not any(c in last for c in "*?["):
        info = store.get_file_info(place)
        if info.type == fs.FileType.File:
            return [(head + place, info.size)]
        folder, last = place.rstrip("/"), "*.zip"
    found = [i for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, last)]
    return sorted((head + i.path, i.size) for i in found)


@dataclass
class Wanted:
    """What filters ask of a column: some values, or beginnings; nothing asked: anything."""

    values: set[str] | None = None
    starts: list[str] = field(default_factory=list)

    def narrow(self, values: set[str]) -> None:
        self.values = values if self.values is None else self.values & values

    def holds(self, x: str | None) -> bool:
        return (self.values is None or x in self.values) and all(x is not None and x.startswith(s) for s in self.starts)


@dataclass
class Part(InputPartition):
    archive: str
    number: int
    of: int


def directory(z: zipfile.ZipFile) -> list[tuple[zipfile.ZipInfo, str, str | None]]:
    """(member, path, what is wrong with it) of an archive's source files by name; a single folder around all members isn't part of the paths."""
    members = [i for i in z.infolist() if not i.is_dir()]
    tops = {i.filename.split("/", 1)[0] for i in members}
    top = next(iter(tops)) + "/" if len(tops) == 1 and all("/" in i.filename for i in members) else ""
    found = []
    for i in sorted(members, key=lambda i: i.filename):
        path = i.filename.replace("\\", "/")
        if path.startswith("/") or ".." in path.split("/"):
            found.append((i, path, "path leaves the archive"))
        elif path.rsplit(".", 1)[-1].lower() in EXTENSIONS:
            found.append((i, path.removeprefix(top), None))
    return found


def unpacked(z: zipfile.ZipFile, member: zipfile.ZipInfo, largest: int) -> tuple[str | None, str | None]:
    """(text, error) of a member. What the directory says of sizes may be wrong, so reading ends at the largest size."""
    try:
        with z.open(member) as f:
            data = f.read(largest + 1)
    except Exception as e:  # whatever a member holds, the others are read
        return None, f"{type(e).__name__}: {e}"
    return (None, "too large") if len(data) > largest else (data.decode("utf-8", "replace"), None)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT))
        self.with_text = str(options.get("text", "true")).lower() != "false"
        self.largest = int(options.get("largest_member", LARGEST_MEMBER))
        self.largest_archive = int(options.get("largest_archive", LARGEST_ARCHIVE)) if is_web(self.path) else None
        self.wanted = {"archive": Wanted(), "path": Wanted(), "language": Wanted()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Rows with an error pass where their path isn't known, so Spark applies every filter again."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.wanted:
                match f:
                    case EqualTo():
                        self.wanted[column].narrow({f.value})
                    case In():
                        self.wanted[column].narrow(set(f.value))
                    case StringStartsWith():
                        self.wanted[column].starts.append(f.value)
            yield f

    def partitions(self) -> list[Part]:
        found = []
        for archive, size in listed(self.path):
            if self.wanted["archive"].holds(archive):
                n = max(1, -(-size // self.split))
                found += [Part(archive, i, n) for i in range(n)]
        return found or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self.rows(partition):
            rows.append(row)
            size += len(row[5] or "") + 100
            if size >= BATCH:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.schema([("archive", pa.string()), ("path", pa.string()), ("language", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("text", pa.string()), ("error", pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def rows(self, part: Part) -> Iterator[tuple]:
        """The rows of an archive's members whose packed bytes begin in this part of it."""
        if not part.of:
            return
        try:
            with opened(part.archive) as file:
                if self.largest_archive is not None and file.raw.size > self.largest_archive:
                    raise ValueError("too large")
                with zipfile.ZipFile(file) as z:
                    found, before = directory(z), 0
                    total = sum(i.compress_size for i, _, _ in found) or 1
                    for member, path, wrong in found:
                        mine = before * part.of // total == part.number
                        before += member.compress_size
                        language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
                        if mine and self.wanted["path"].holds(path) and self.wanted["language"].holds(language):
                            text, error = (None, wrong) if wrong or not self.with_text else unpacked(z, member, self.largest)
                            yield part.archive, path, language, member.file_size, member.compress_size, text, error
        except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError, urllib.error.URLError) as e:
            if not part.number:
                yield part.archive, None, None, None, None, None, str(e)


class ZipMembers(DataSource):
    """archive, path, language, size, packed, text and error of the source files in ZIP archives.

    A broken archive gives one row with an error, and so does a member that would leave the archive's folder, unpacks to more
    than `largest_member` bytes or can't be read. Members that are no source files give no rows."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """The source files of the archives that a path names; see ZipMembers. Filters of the frame reach the archives' directories."""
    prepare(spark).dataSource.register(ZipMembers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("zip_members").options(**options).load(path)


def snapshot(spark: SparkSession, repository: str, branches: tuple[str, ...] = ("main", "master", "develop", "trunk")) -> DataFrame:
    """The source files of the first branch that a repository's address has an archive for; {} in the address stands for the branch. No branch: one row with an error."""
    last = "no branch was asked for"
    for branch in branches:
        url = repository.format(branch)
        try:
            RangeFile(url)
        except (OSError, urllib.error.URLError) as e:
            last = f"{branch}: {e}"
            continue
        return members(spark, url)
    return spark.createDataFrame([(repository, None, None, None, None, None, last)], SCHEMA)


def write_archives(files: DataFrame, folder: str, by: str, path: str = "path", text: str = "text") -> DataFrame:
    """Write one ZIP file for each value of a column, named after it, into a folder of a store; gives (archive, members).

    A file is written by one task, under the same name whenever the task is repeated. Its members come sorted and are written
    one by one, so a task holds a batch of texts and the archive's directory, however large the archive is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(place, recursive=True)
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for key, held in itertools.groupby(rows, key=lambda r: r[0]):
            members = 0
            with store.open_output_stream(f"{place}/{key}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, p, t in held:
                    z.writestr(zipfile.ZipInfo(p), t or "", zipfile.ZIP_DEFLATED)
                    members += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{key}.zip"]), pa.array([members], pa.int64())], names=["archive", "members"])

    prepare(files.sparkSession)
    rows = files.select(files[by].alias("__by"), files[path].alias("path"), files[text].alias("text"))
    return rows.repartition("__by").sortWithinPartitions("__by", "path").mapInArrow(run, "archive string, members long")
