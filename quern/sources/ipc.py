"""Arrow IPC files (file and stream format) as a data source: one partition a file; record batches pass without conversion. And a writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    fs, inner = (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)
    return fs, inner


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        magic = f.read(6)
        f.seek(0)
        if magic == b"ARROW1":
            reader = pa.ipc.open_file(f)
            yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
        else:
            yield from pa.ipc.open_stream(f)


def _schema(path: str) -> pa.Schema:
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        magic = f.read(6)
        f.seek(0)
        return (pa.ipc.open_file(f) if magic == b"ARROW1" else pa.ipc.open_stream(f)).schema


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _files(self) -> list[str]:
        fs, inner = file_system(self.options["path"])
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.File:
            return [self.options["path"]]
        head = self.options["path"][: len(self.options["path"]) - len(inner)] if "://" in self.options["path"] else ""
        return sorted(head + x.path for x in fs.get_file_info(pafs.FileSelector(inner)) if x.path.endswith((".arrow", ".ipc", ".feather")))

    def schema(self):
        return from_arrow_schema(_schema(self._files()[0]))

    def reader(self, schema) -> ArrowReader:
        return ArrowReader(self._files(), schema.fieldNames())


class ArrowReader(DataSourceReader):
    def __init__(self, files: list[str], names: list[str]):
        self.files, self.names = files, names

    def partitions(self) -> list[FilePart]:
        return [FilePart(f) for f in self.files]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        for b in _batches(partition.path):
            yield b.select(self.names)


def write(df: DataFrame, path: str) -> int:
    """A file for each partition that has rows, added to the folder; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None
        for b in batches:
            if w is None:
                fs, inner = file_system(path)
                fs.create_dir(inner, recursive=True)
                w = pa.ipc.new_file(f := fs.open_output_stream(f"{inner}/part-{uuid.uuid4().hex}.arrow"), b.schema)
            w.write(b)
        if w is not None:
            w.close()
            f.close()
            yield pa.record_batch({"n": [1]})

    return df.mapInArrow(run, "n long").count()
