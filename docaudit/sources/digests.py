"""Digests of files of any size, as a Spark data source.

The ``binaryFile`` source puts a whole file into one cell, which ends at 2 GiB and needs the memory. This source reads a
file in pieces inside the task and returns only its path, length, first bytes and SHA-256.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, length bigint, head binary, file_hash string"


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


def _location(path: str):
    from pyarrow import fs  # on the executors

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def digest(stream, piece_bytes: int, head_bytes: int) -> tuple[int, bytes, str]:
    """Length, first bytes and SHA-256 of a binary stream."""
    sha, length, head = hashlib.sha256(), 0, b""
    while piece := stream.read(piece_bytes):
        sha.update(piece)
        length += len(piece)
        head += piece[: head_bytes - len(head)] if len(head) < head_bytes else b""
    return length, head, sha.hexdigest()


class DigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.glob = options.get("pathglobfilter", "*")
        self.piece = max(1, int(options.get("piecebytes", 8 << 20)))
        self.head = int(options.get("headbytes", 1024))
        self.group = int(options.get("groupbytes", 128 << 20))

    def partitions(self) -> list[FileGroup]:
        """Files below the folder in groups of about ``groupBytes``; like any file source, the driver lists names and sizes."""
        from pyarrow import fs

        system, root = _location(self.root)
        prefix = self.root[: len(self.root) - len(root.rstrip("/"))] if self.root.endswith(root.rstrip("/")) else ""
        groups: list[FileGroup] = []
        size = self.group
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            hidden = any(part[:1] in "._" for part in info.path[len(root) :].split("/") if part)
            if info.type != fs.FileType.File or hidden or not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            if size >= self.group:
                groups.append(FileGroup([]))
                size = 0
            groups[-1].paths.append(prefix + info.path)
            size += info.size + (1 << 20)  # opening a file costs as much as reading a megabyte
        return groups

    def read(self, partition: FileGroup) -> Iterator[tuple[str, int, bytes, str]]:
        for path in partition.paths:
            system, inner = _location(path)
            with system.open_input_stream(inner) as stream:
                yield (path, *digest(stream, self.piece, self.head))


class FileDigests(DataSource):
    """Format ``file_digests``. Options: path, pathGlobFilter, pieceBytes, headBytes, groupBytes."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DigestReader:
        return DigestReader({k.lower(): v for k, v in self.options.items()})


def read_digests(spark: SparkSession, path: str, glob: str = "*", **options: int) -> DataFrame:
    """(path, length, head, file_hash) of all files below a folder; hidden ones are skipped."""
    spark.dataSource.register(FileDigests)
    reader = spark.read.format("file_digests").option("pathGlobFilter", glob)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(path)
