"""A streaming source of lines appended to files: offsets are bytes for each file.

The first sight of the folder anchors at the files' ends unless ``from`` is ``start``; a file that
shrank is read from its new end. Only whole lines are read; a partial last line waits.

With a ``ledger`` (a file below the shared folder) admission is controlled: ``bytes`` bounds what a
batch takes, ``run_bytes`` what a run takes, and ``seconds`` is a run's deadline, looked at between
files. Files whose paths have the parts in ``order`` (comma-separated) come first, then all by name;
what isn't admitted waits for the next batch or run. The ledger holds the end of the last planned
batch and belongs to the query's checkpoint, which says what was read: neither goes without the other.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: What one task reads at most; a line belongs to the span that its end lies in.
SPAN_BYTES = 64 << 20
_BACK = 1 << 16


class Span(InputPartition):
    """Bytes [start, end) of one file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def admitted(before: dict[str, int], sizes: dict[str, int], order: list[str], most: int | None, end: float | None = None, clock=time.monotonic) -> dict[str, int]:
    """How far files may be read: by priority, then by name, until ``most`` new bytes or the time ``end`` (looked at between files) are used up."""
    left, out = most, {}
    rank = {p: next((i for i, part in enumerate(order) if part in p), len(order)) for p in sizes}
    for p in sorted(sizes, key=lambda p: (rank[p], p)):
        at = min(before.get(p, 0), sizes[p])
        late = end is not None and clock() >= end
        take = 0 if late else sizes[p] - at if left is None else min(left, sizes[p] - at)
        left = None if left is None else left - take
        out[p] = at + take
    return out


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.suffix, self.origin = options["path"], options.get("suffix", ".jsonl"), options.get("from", "end")
        self.ledger = options.get("ledger")
        self.most, self.run_most = (int(options[k]) if k in options else None for k in ("bytes", "run_bytes"))
        self.end = time.monotonic() + float(options["seconds"]) if "seconds" in options else None
        self.base: int | None = None  # bytes that were admitted before this run
        self.order = [x for x in options.get("order", "").split(",") if x]
        if {"bytes", "run_bytes", "seconds"} & set(options) and not self.ledger:
            raise ValueError("a limit on what a batch admits needs a ledger")

    def _sizes(self) -> dict[str, int]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix)}

    def _remembered(self) -> dict[str, int] | None:
        fs, path = pafs.FileSystem.from_uri(self.ledger)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _remember(self, offset: dict[str, int]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.ledger)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(offset).encode())
        fs.move(f"{path}.new", path)

    def initialOffset(self) -> dict:
        if self.ledger and (known := self._remembered()) is not None:
            return known
        offset = {} if self.origin == "start" else self._sizes()
        if self.ledger:
            self._remember(offset)
        return offset

    def latestOffset(self) -> dict:
        sizes = self._sizes()
        if not self.ledger:
            return sizes
        before = self._remembered()
        if before is None:  # a first run may ask for the end before the beginning
            before = self.initialOffset()
        if self.base is None:
            self.base = sum(before.values())
        limits = [x for x in (self.most, None if self.run_most is None else max(0, self.run_most - sum(before.values()) + self.base)) if x is not None]
        return admitted(before, sizes, self.order, min(limits, default=None), self.end)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if self.ledger:  # a batch is planned: the next one goes on from its end
            self._remember(end)
        spans = []
        for p, n in sorted(end.items()):
            spans += [Span(p, at, min(at + SPAN_BYTES, n)) for at in range(start.get(p, 0), n, SPAN_BYTES)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
            cut = data.rfind(b"\n")
            if cut < 0:  # no line ends here: the span that has its end reads it
                return
            held, at = [data[: cut + 1]], partition.start
            while at:  # the first line's bytes from earlier spans and batches
                low = max(0, at - _BACK)
                f.seek(low)
                before = f.read(at - low)
                end = before.rfind(b"\n")
                held.append(before[end + 1 :])
                at = low + end + 1
                if end >= 0:
                    break
        name = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for line in b"".join(reversed(held)).split(b"\n")[:-1]:
            start, at = at, at + len(line) + 1
            yield name, at, line.rstrip(b"\r").decode("utf-8", "replace"), start

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """``spark.readStream.format("appended_lines").load(folder)``: (session_id, end_offset, value, start_offset)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "session_id string, end_offset bigint, value string, start_offset bigint"

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options)
