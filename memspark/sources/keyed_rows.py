"""A streaming sink whose batches count once: rows as Parquet parts, published by batch id.

Tasks write parts under names of their own; the commit of a batch writes a list of its parts, unless
that batch has one already. A batch that is run or committed again therefore adds no row, and parts
of a killed attempt are on no list. :func:`committed` reads what the lists name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Part(WriterCommitMessage):
    """A task's file, or none if it had no rows."""

    name: str | None


class KeyedWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        for b in iterator:
            if b.num_rows:
                if writer is None:
                    fs.create_dir(f"{folder}/parts", recursive=True)
                    writer = pq.ParquetWriter(f"{folder}/parts/{name}", b.schema, filesystem=fs)
                writer.write_batch(b)
        if writer is None:
            return Part(None)
        writer.close()
        return Part(name)

    def _list(self, batch: int) -> tuple[pafs.FileSystem, str, str]:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        return fs, folder, f"{folder}/batches/{batch:012d}.json"

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803  the interface's name
        fs, folder, path = self._list(batchId)
        names = [m.name for m in messages if m is not None and m.name]
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            self._drop(fs, folder, names)
            return
        fs.create_dir(f"{folder}/batches", recursive=True)
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(names).encode())
        fs.move(f"{path}.new", path)

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        fs, folder, _ = self._list(batchId)
        self._drop(fs, folder, [m.name for m in messages if m is not None and m.name])

    @staticmethod
    def _drop(fs: pafs.FileSystem, folder: str, names: list[str]) -> None:
        for n in names:
            if fs.get_file_info(f"{folder}/parts/{n}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{folder}/parts/{n}")


class KeyedRows(DataSource):
    """``writeStream.format("keyed_rows").start(folder)`` with a folder that driver and executors share, as a URI."""

    @classmethod
    def name(cls) -> str:
        return "keyed_rows"

    def streamWriter(self, schema: StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(self.options)


def committed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches; the lists of parts reach the driver, a name for each part."""
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(f"{path}/batches", allow_not_found=True))
    names = []
    for f in found:
        if f.path.endswith(".json"):
            with fs.open_input_stream(f.path) as g:
                names += json.loads(g.read())
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/parts/{n}" for n in names))
