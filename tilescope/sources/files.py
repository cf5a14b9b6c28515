"""Whole files in a shared folder: digests as a Spark data source, contents of chosen files, and a writer.

Folders are URIs of a file system that PyArrow opens, or absolute paths, reachable from every executor.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time, and bytes of files that one task is given, unless a single file has more.
PIECE = 4 << 20
SPLIT = 128 << 20


def _opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", folder)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs, root.rstrip("/")


class Files(InputPartition):
    """Files of one task: (name below the folder, offset, length); whole files, as a digest cannot be joined from parts."""

    def __init__(self, splits: list[tuple[str, int, int]]):
        super().__init__(0)
        self.splits = splits


class FileHashSource(DataSource):
    """(path, bytes, sha256) of the files below a folder whose name below it matches ``glob``.

    The driver lists names and lengths only; tasks stream each file in pieces of PIECE bytes, so no file is held whole.
    Names that start with ``_`` or ``.`` are passed over, as by Spark's own readers.
    """

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, bytes bigint, sha256 string"

    def reader(self, schema: T.StructType) -> FileHashReader:
        return FileHashReader(self.options["path"], self.options.get("glob", "*"), int(self.options.get("split", SPLIT)))


class FileHashReader(DataSourceReader):
    def __init__(self, folder: str, glob: str, split: int):
        self.folder, self.glob, self.split = folder, glob, split

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = sorted((f.path[len(root) + 1:], f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.base_name[0] not in "_.")
        parts, held = [], 0
        for name, size in files:
            if not fnmatch.fnmatchcase(name, self.glob):
                continue
            if not parts or held + size > self.split:
                parts.append(Files([]))
                held = 0
            parts[-1].splits.append((name, 0, size))
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        fs, root = _opened(self.folder)
        for name, _, _ in partition.splits:
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    size += len(piece)
            yield name, size, digest.hexdigest()


def hash_files(spark: SparkSession, folder: str, glob: str = "*", split: int = SPLIT) -> DataFrame:
    """(path, bytes, sha256) of the files below ``folder``, by ``FileHashSource``."""
    spark.dataSource.register(FileHashSource)
    return spark.read.format("file_hashes").option("glob", glob).option("split", split).load(folder)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each (name, content) row as a file below ``folder``, over any of that name; returns how many.

    A task that runs again writes the same files again. Names must not repeat.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    content = rows.selectExpr("cast(name as string)", "cast(content as binary)")
    return sum(r["n"] for r in content.mapInArrow(write, "n bigint").groupBy().sum("n").toDF("n").collect() if r["n"])


def read_contents(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``paths`` with the ``content`` of each file: only the files named are opened, one at a time in each task."""
    names = paths.columns
    schema = T.StructType([*paths.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(names.index(path_col)).to_pylist()):
                fs, root = _opened(path)
                with fs.open_input_stream(root, compression=None) as stream:
                    yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([stream.read()], pa.binary())], names=schema.names)

    return paths.mapInArrow(read, schema)
