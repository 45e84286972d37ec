"""Best-fit packing of documents into sequences of bounded length, bulk-synchronously.

Documents are encoded, those longer than a sequence are cut, and the pieces are range-sorted by
length, longest first. Sequences with room left are *gaps*, kept sorted by their room. A round takes the longest
pieces that are left, all of one length: its gap is the smallest that holds them (the successor in
the order of gaps), conflicts are settled by rank (the piece of rank r among its equals goes to the
r-th place among equal gaps), gaps get their new room, and the next round begins. Where no gap is
wide enough, new sequences open. This is best-fit decreasing over all pieces.

Pieces of one length, and gaps of one room, differ in nothing but rank, so what a round does is said by
*runs*: an interval of ranks goes to an interval of sequences. There are at most as many lengths as a
sequence has places, however many documents there are; so rounds work on runs, and rows are met
twice: when range-sorting gives each its rank, and when each looks its rank up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memspark.llm.byte_words import coder
from memspark.session import drop_scratch, materialize, ship_package

CAPACITY = 1024
END_ID = 2
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACES = "sequence_id bigint, offset bigint"


class Gaps:
    """Open sequences by the room that they have left, as runs of consecutive sequences."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.runs[room]:
                insort(self.rooms, room)
            self.runs[room].append((first, n))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Take out a run of sequences with the least room that holds ``length``: (room, first, n)."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.rooms[i]
        return room, first, n


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rounds of best fit over runs, longest first: ([(length, first rank, first sequence, pieces a sequence, offset)], sequences).

    In each entry the pieces of consecutive ranks fill the sequences from the first one on, so many in each.
    """
    gaps, out, opened = Gaps(), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = gaps.successor(length)
            room, first, n = found or (capacity, opened, -(-left // (capacity // length)))
            each = room // length
            if not found:
                opened += n
            taken = min(left, n * each)
            out.append((length, rank, first, each, capacity - room))
            full, rest = divmod(taken, each)
            gaps.add(room - each * length, first, full)
            if rest:
                gaps.add(room - rest * length, first + full, 1)
            used = full + bool(rest)
            gaps.add(room, first + used, n - used)
            rank, left = rank + taken, left - taken
    return out, opened


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): encoded documents, cut if they are too long; a shorter piece comes first."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        tail = np.array([end_id], dtype="<u4")
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for doc, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    whole = np.concatenate([ids.astype("<u4"), tail])
                    bounds = [0, *range((len(whole) - 1) % capacity + 1, len(whole) + 1, capacity)]
                    raw = memoryview(whole.tobytes())
                    rows += [(doc, k, x, y - x, zlib.crc32(raw[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False))]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row its sequence and its place there: adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    Rows are range-sorted by length and written, with their place among equals of their range.
    Of these only the number of rows for each range and length reaches the driver, at most one
    for each range and one for each length. Other columns pass through, but for the three that are added.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "_range", "_place")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = F.xxhash64(*pieces.columns)
    ordered = pieces.repartitionByRange(parts, F.desc("length"), mixed).sortWithinPartitions(F.desc("length"), mixed)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            length = b.column("length").to_numpy()
            begin = np.flatnonzero(np.diff(length, prepend=-1))
            size = np.diff(np.append(begin, len(length)))
            place = np.arange(len(length)) - np.repeat(begin, size) + seen[length]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(place)], names=[*b.schema.names, "_range", "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    table = materialize(ordered.mapInArrow(ranked, f"{fields}, _range int, _place bigint"), "ranked")
    total: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for part, length, n in sorted(tuple(r) for r in table.groupBy("_range", "length").count().collect()):
        before[part, length] = total[length]
        total[length] += n
    plan, _ = best_fit(dict(total), capacity)
    steps = np.array(plan, dtype=np.int64).reshape(-1, 5)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    key = steps[:, 0] << 52 | steps[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, place = (b.column(c).to_numpy() for c in ("length", "_range", "_place"))
            rank = place + np.array([before[x] for x in zip(part.tolist(), length.tolist(), strict=True)], dtype=np.int64)
            _, first, sequence, each, offset = steps[np.searchsorted(key, length << 52 | rank, side="right") - 1].T
            at, within = np.divmod(rank - first, each)
            kept = [b.column(i) for i, c in enumerate(b.schema.names) if c not in ("_range", "_place")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence + at), pa.array(offset + within * length)], names=[*(c for c in b.schema.names if c not in ("_range", "_place")), "sequence_id", "offset"])

    return table.mapInArrow(placed, f"{fields}, {_PLACES}")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null text counts as empty and is its end id alone. Null and repeated ids are rows like any
    other; other columns of ``docs`` don't matter. No documents give no rows.
    """
    pieces = materialize(pieces_of(docs, tokenizer, capacity), "pieces")
    out = pack(pieces, capacity)
    drop_scratch(pieces)
    return out
