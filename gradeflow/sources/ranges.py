"""Digests of files of any size, and files of single records, as Spark reads and writes them.

``file_ranges`` is a data source whose partitions are byte ranges of files: a range is read in small pieces, so memory
is bounded whatever a file's size, and a large file is read by many tasks. The digest of a file of one range is the
plain SHA-256 of its bytes; that of a larger file is the SHA-256 of its ranges' digests in order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ship import ship_package

#: Bytes of a range, those read at once, and most files of a task.
RANGE, PIECE, FILES = 64 << 20, 1 << 20, 1000


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path there; ``file:/x`` is taken as ``file:///x``."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


@dataclass
class Share(InputPartition):
    """What one task reads: (path, number, start, length, size) of some byte ranges."""

    ranges: list[tuple[str, int, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, step: int, digests: bool):
        self.folder, self.step, self.digests = folder, step, digests

    def _ranges(self) -> Iterator[tuple[str, int, int, int, int]]:
        fs, path = opened(self.folder)
        root = fs.get_file_info(path)
        single = root.type == pa.fs.FileType.File
        files = [root] if single else [x for x in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if x.type == pa.fs.FileType.File]
        for x in sorted(files, key=lambda x: x.path):
            below = x.path[len(path.rstrip("/")) :]
            if single or not any(p.startswith((".", "_")) for p in below.split("/")):  # hidden ones, as Spark's own readers
                for i, at in enumerate(range(0, max(x.size, 1), self.step)):
                    yield self.folder if single else self.folder.rstrip("/") + below, i, at, min(self.step, x.size - at), x.size

    def partitions(self) -> list[Share]:
        """Ranges in turn until a share has the bytes of one whole range, or many small files."""
        out, now, held = [], [], 0
        for r in self._ranges():
            if now and (held + r[3] > self.step or len(now) >= FILES):
                out.append(Share(now))
                now, held = [], 0
            now.append(r)
            held += r[3]
        return [*out, Share(now)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, number, start, length, size in partition.ranges:
            yield path, size, number, start, length, self._digest(path, start, length) if self.digests else None

    @staticmethod
    def _digest(path: str, start: int, left: int) -> str:
        fs, at = opened(path)
        digest = hashlib.sha256()
        with fs.open_input_file(at) as file:
            file.seek(start)
            while left:
                piece = file.read(min(PIECE, left))
                if not piece:
                    raise OSError(f"{path} has become shorter")
                digest.update(piece)
                left -= len(piece)
        return digest.hexdigest()


class FileRanges(DataSource):
    """``spark.read.format("file_ranges").option("folder", ...)``, with ``range`` bytes each; without ``digests`` files are only listed."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, size long, number int, start long, length long, digest string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["folder"], int(self.options.get("range", RANGE)), self.options.get("digests", "true") == "true")


def file_ranges(spark: SparkSession, folder: str, step: int = RANGE, digests: bool = True) -> DataFrame:
    """(path, size, number, start, length, digest) of each byte range of every file below a folder, or of one file; hidden ones are passed over."""
    ship_package(spark)
    spark.dataSource.register(FileRanges)
    return spark.read.format("file_ranges").options(folder=folder, range=step, digests=str(digests).lower()).load()


def file_digests(spark: SparkSession, folder: str, step: int = RANGE) -> DataFrame:
    """(path, size, digest) of every file below a folder. A group is a file's ranges: one row for each 64 MB."""
    parts = file_ranges(spark, folder, step).groupBy("path", "size").agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("p"))
    return parts.select("path", "size", F.when(F.size("p") == 1, F.col("p")[0]["digest"]).otherwise(F.sha2(F.array_join("p.digest", ""), 256)).alias("digest"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row of ``files(name, text)`` as a file of its own, written beside and then renamed; names may have folders.

    Tasks write, so the driver sees no row; a task that runs again writes the same files again.
    """
    ship_package(files.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root.rstrip('/')}/{name}"
                where, _, last = path.rpartition("/")
                fs.create_dir(where, recursive=True)
                new = f"{where}/.{last}.{uuid.uuid4().hex}"
                with fs.open_output_stream(new) as out:
                    out.write((text or "").encode())
                fs.move(new, path)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    files.select("name", "text").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
