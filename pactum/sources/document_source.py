"""Contract files as a Spark data source: spark.read.format("contract_files").load(folder).

    register(spark)
    spark.read.format("contract_files").option("splitBytes", 64 << 20).load("/shared/contracts").where("kind = 'page'")

The driver lists names and sizes only.  Files are dealt to partitions of about `splitBytes`, large ones by themselves, and
each task opens its files one after the other, so it holds one file at a time.  Every file gives one row of READ: a page, a
reject that says what is wrong, or a row of kind other.  The option `pathGlobFilter` keeps files by their names while listing,
as in Spark's own file sources, so others are never opened.

Handling: files without a byte are pages without text; a file that goes away or can't be opened between listing and reading is a
reject; files of one name in several folders are files of their own; names and folders that begin with "_" or "." are left
out, as Spark does; an empty folder gives no row; a path that isn't there is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pactum.sources.files import READ, read_file, read_schema

NAME = "contract_files"
#: A partition takes files up to so many bytes; opening a file counts as OPEN_BYTES.
SPLIT_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
#: Rows of one Arrow batch reach about so many bytes of text.
BATCH_BYTES = 8 << 20


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContractFiles)


class ContractFiles(DataSource):
    """Batch reader over one or more folders or files (several: joined by commas in the option `paths`)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return ContractFilesReader(self.options)


@dataclass
class Files(InputPartition):
    paths: list[str]


def store_of(path: str):
    """(file system, path in it, what stands before it) for a path of this machine or of any store that Arrow reads."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        import os

        return fs.LocalFileSystem(), os.path.abspath(path), ""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside, path[: len(path) - len(inside)]


def listed(path: str) -> Iterator[tuple[str, int]]:
    """(path, size) of every file below a path, in order of names; hidden ones are left out."""
    from pyarrow import fs

    store, inside, before = store_of(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        below = f.path[len(inside) :].strip("/") or f.base_name
        if f.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in below.split("/")):
            yield before + f.path, f.size or 0


def dealt(files: list[tuple[str, int]], split: int) -> list[Files]:
    """Files in partitions of about `split` bytes: the largest first, each to the partition that has least so far."""
    import heapq

    total = sum(size + OPEN_BYTES for _, size in files)
    parts = [(0, k) for k in range(min(len(files), -(-total // max(split, 1))))]
    paths: list[list[str]] = [[] for _ in parts]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        had, k = parts[0]
        paths[k].append(path)
        heapq.heapreplace(parts, (had + size + OPEN_BYTES, k))
    return [Files(sorted(p)) for p in paths]


class ContractFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        given = options.get("paths") or options.get("path")
        if not given:
            raise ValueError(f"{NAME} needs a path")
        self.paths = [p.strip() for p in given.split(",")] if options.get("paths") else [given]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.names = options.get("pathglobfilter") or "*"

    def partitions(self) -> list[Files]:
        files = sorted({f for path in self.paths for f in listed(path) if fnmatchcase(f[0].rsplit("/", 1)[-1], self.names)})
        return dealt(files, self.split) or [Files([])]

    def read(self, partition: Files):
        import pyarrow as pa

        rows, size = [], 0
        for path in partition.paths:
            rows.append(read_file(path, lambda path=path: _content(path)))
            size += len(rows[-1].get("text", "")) + 64
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=read_schema())
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=read_schema())


def _content(path: str) -> bytes:
    store, inside, _ = store_of(path)
    with store.open_input_stream(inside) as stream:
        return stream.read()
