"""Cross-tokenizer alignment through inverted bitmaps of id pairs.

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). An A and a B token
are linked where their bytes overlap. Documents are numbered within blocks; in a block every
linked id pair has a compressed bitmap of its documents (plane 0) and, for what links it has beyond
one in a document, a bitmap for each binary digit of that number (planes 1, 2, ...). A bitmap is
either a list of 16-bit places or packed bits, whichever is shorter. Batches of a block are ORed
into one bitmap for each pair, blocks hold different documents, and popcounts stand beside the
bitmaps: a pair's number of documents is the sum of plane 0's, its number of links adds
2^(k-1) times plane k's.

The scores of pairs (links in the corpus, and whether these are the most for the B id) then meet
the bitmaps again and go back to the documents along them, block by block. A pair has a few rows for
each block at most, so no pair is hot; a block is bounded by documents and links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memspark.llm.byte_words import coder as byte_coder, units
from memspark.session import materialize, ship_package

#: Documents, and units with links, of a block (a longer document is a block by itself).
BLOCK, BLOCK_UNITS = 1024, 1 << 20
#: Units that a worker remembers; a full memory is emptied.
REMEMBERED = 700_000
_PLACE_BITS, _COUNT_BITS = 10, 22
_U = np.uint64
_CODERS: dict[tuple[str, str], PairCoder] = {}
_STRUCTURE = "block bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair bigint, plane int, width int, n bigint, bits binary"


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), dtype=a.dtype)])


class PairCoder:
    """Aligns texts unit by unit; remembers each unit's counts, groups and links."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.a, self.b = byte_coder(byte_path, True), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = self.a.token_bytes()
        b, self.blank = self.b, self.b.piece_to_id("▁")
        self.bytes_b = [b"" if b.is_control(i) else bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.bytes_a, self.bytes_b))
        # Ids as text with what follows them: A's "," or "|", then B's "," or ";".
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        if size_a > 1 << 16 or size_b > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.said = [b"%d%s" % (i, mark) for n, marks in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for mark in marks for i in range(n)]
        self.said_len = np.array(list(map(len, self.said)), dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = np.zeros((1024, 5), dtype=np.int64)  # A ids, B ids, groups, links, whether bytes differ
        self.at, self.links, self.n_links = np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.uint32), 0
        self.weight = 0

    def learn(self, new: list[str]) -> None:
        """Align units that aren't known yet; each stands after a blank."""
        for i in range(0, len(new), 8192):
            self._learn(new[i : i + 8192])

    def _learn(self, new: list[str]) -> None:
        raw = [b" " + w.encode() for w in new]
        ids_a = [np.frombuffer(x, dtype=self.a.dtype) for x in self.a.ids(new, " ")]
        ids_b = [x or [self.blank] for x in self.b.encode(new, num_threads=1)]  # the library gives an empty text no blank in front
        size = np.array(list(map(len, raw)), dtype=np.int64)
        n_a, n_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (ids_a, ids_b))
        flat_a = np.concatenate(ids_a).astype(np.int64)
        flat_b = np.fromiter((i for x in ids_b for i in x), dtype=np.int64, count=int(n_b.sum()))
        owner_a, owner_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        differ = np.zeros(len(new), dtype=bool)
        whole = b"".join(raw)
        for flat, owner, known, lens in ((flat_a, owner_a, self.bytes_a, self.len_a), (flat_b, owner_b, self.bytes_b, self.len_b)):
            differ |= np.bincount(owner, weights=lens[flat], minlength=len(new)).astype(np.int64) != size
            if not differ.any() and b"".join(map(known.__getitem__, flat.tolist())) == whole:
                continue
            cuts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(new))))
            for k in range(len(new)):
                differ[k] |= b"".join(map(known.__getitem__, flat[cuts[k] : cuts[k + 1]].tolist())) != raw[k]
        # Ends of the tokens among all units' bytes; A's and B's agree at the units' ends.
        keep_a, keep_b = ~differ[owner_a], ~differ[owner_b]
        a, b, owner_a, owner_b = flat_a[keep_a], flat_b[keep_b], owner_a[keep_a], owner_b[keep_b]
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        every = np.union1d(end_a, end_b)  # each stretch between ends is one link
        link_a, link_b = np.searchsorted(end_a, every), np.searchsorted(end_b, every)
        owner = owner_a[link_a] if len(every) else owner_a
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = np.isin(end_a, shared, assume_unique=True), np.isin(end_b, shared, assume_unique=True)
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        words = np.concatenate([a + size_a * last_a, 2 * size_a + b + size_b * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words, owners = words[order], np.concatenate([owner_a, owner_b])[order]
        text = b"".join(map(self.said.__getitem__, words.tolist()))
        ends = np.cumsum(np.bincount(owners, weights=self.said_len[words], minlength=len(new)).astype(np.int64))
        first, total = len(self.groups), len(self.groups) + len(new)
        self.groups += [text[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        self.counts, self.at = (_grown(x, total) if x.ndim == 1 else x if total <= len(x) else np.concatenate([x, np.zeros((max(total - len(x), len(x)), 5), dtype=np.int64)]) for x in (self.counts, self.at))
        n_links = np.bincount(owner, minlength=len(new)) if len(every) else np.zeros(len(new), dtype=np.int64)
        self.counts[first:total] = np.stack([np.bincount(owner_a, minlength=len(new)), np.bincount(owner_b, minlength=len(new)), np.bincount(owner_a[last_a], minlength=len(new)), n_links, differ], axis=1)
        self.at[first:total] = self.n_links + np.cumsum(n_links) - n_links
        codes = (a[link_a] << 16 | b[link_b]).astype(np.uint32)
        self.links = _grown(self.links, self.n_links + len(codes))
        self.links[self.n_links : self.n_links + len(codes)] = codes
        self.n_links += len(codes)
        self.known.update(zip(new, range(first, total), strict=True))
        self.weight += len(new) + int(size.sum()) // 64

    def links_of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs of units, and for each the place in ``unit`` that it comes from."""
        n = self.counts[unit, 3]
        owner = np.repeat(np.arange(len(unit)), n)
        return self.links[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.at[unit], n)], owner


def coder(byte_path: str, piece_path: str) -> PairCoder:
    """One coder for each worker."""
    if (byte_path, piece_path) not in _CODERS:
        _CODERS[byte_path, piece_path] = PairCoder(byte_path, piece_path)
    return _CODERS[byte_path, piece_path]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each stands there."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[begin], np.diff(np.append(begin, len(key)))


class Block:
    """The documents of one block and the bitmaps of their id pairs."""

    def __init__(self, number: int) -> None:
        self.number, self.n, self.n_units = number, 0, 0
        self.parts: list[np.ndarray] = []  # of each batch: pair << 32 | place << 22 | links, sorted

    def add(self, own: PairCoder, place: np.ndarray, unit: np.ndarray) -> None:
        """Add a batch: the place of a document for each of its units."""
        found, times = _counted(np.sort(place.astype(_U) << _U(32) | unit.astype(_U)))
        most = (1 << _COUNT_BITS) - 1
        pair, owner = own.links_of((found & _U(0xFFFFFFFF)).astype(np.int64))
        times, at = times[owner], found[owner] >> _U(32) << _U(_COUNT_BITS)
        key = pair.astype(_U) << _U(32) | at
        parts = [key | np.minimum(times, most).astype(_U)]
        while (times := times - most).max(initial=0) > 0:
            parts.append((key | np.clip(times, 0, most).astype(_U))[times > 0])
        self.parts += [np.sort(np.concatenate(parts))]

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(pair, plane, popcount, offsets, bytes) of all bitmaps: lists of places first, then packed bits."""
        every = np.sort(np.concatenate(self.parts)) if self.parts else np.zeros(0, dtype=_U)
        at = every >> _U(_COUNT_BITS)
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
        more = (np.add.reduceat((every & _U((1 << _COUNT_BITS) - 1)).astype(np.int64), begin) if len(at) else np.zeros(0, dtype=np.int64)) - 1
        at, width = at[begin], -(-self.n // 8)
        planes = [(0, at)] + [(k + 1, at[(more >> k & 1) == 1]) for k in range(int(more.max(initial=0)).bit_length())]
        for plane, at in planes:
            pair, n = _counted(at >> _U(_PLACE_BITS))
            place = (at & _U((1 << _PLACE_BITS) - 1)).astype("<u2")
            listed = 2 * n < width
            cuts = np.append(0, np.cumsum(2 * n[listed]))
            yield pair[listed], plane, n[listed], cuts, place[np.repeat(listed, n)].tobytes()
            dense = np.zeros((int((~listed).sum()), self.n), dtype=bool)
            dense[np.repeat(np.arange(len(dense)), n[~listed]), place[np.repeat(~listed, n)]] = True
            yield pair[~listed], plane, n[~listed], np.arange(len(dense) + 1) * width, np.packbits(dense, axis=1, bitorder="little").tobytes()


def places_of(width: int, size: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All (bitmap, place) of bitmaps of ``size`` bytes each that stand one after the other."""
    dense = size == width
    buffer, one = np.frombuffer(raw, dtype=np.uint8), np.repeat(dense, size)
    listed = np.frombuffer(buffer[~one].tobytes(), dtype="<u2").astype(np.int64)
    row, at = np.nonzero(np.unpackbits(buffer[one].reshape(-1, width), axis=1, bitorder="little"))
    return np.concatenate([np.repeat(np.flatnonzero(~dense), size[~dense] // 2), np.flatnonzero(dense)[row]]), np.concatenate([listed, at])


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of two kinds, block by block: documents (pair is null) with their counts, and bitmaps of id pairs (doc_id and place are null)."""
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in _STRUCTURE.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _STRUCTURE.split(", ")])

    def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, schema.field(c).type) for c in names], schema=schema)

    def flush(block: Block) -> Iterator[pa.RecordBatch]:
        for pair, plane, n, cuts, raw in block.rows():
            if len(pair):
                bits = pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                same = lambda x, kind: pa.array(np.full(len(pair), x), kind)
                yield batch(len(pair), block=same(block.number, pa.int64()), pair=pa.array(pair.astype(np.int64)), plane=same(plane, pa.int32()), width=same(-(-block.n // 8), pa.int32()), n=pa.array(n, pa.int64()), bits=bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                ids, texts = part.column(0), part.column(1).to_pylist()
                cut = [units(t) if t else [] for t in texts]
                new = set().union(*cut)
                if own.weight + len(new) > REMEMBERED:
                    own.forget()
                own.learn([w for w in new if w not in own.known])
                size = np.array(list(map(len, cut)), dtype=np.int64)
                unit = np.fromiter((own.known[w] for c in cut for w in c), dtype=np.int64, count=int(size.sum()))
                doc = np.repeat(np.arange(len(cut)), size)
                sums = np.zeros((len(cut), 5), dtype=np.int64)
                if len(unit):
                    full = np.flatnonzero(size)
                    sums[full] = np.add.reduceat(own.counts[unit], (np.cumsum(size) - size)[full])
                fit = (sums[:, 4] == 0) & (size > 0)
                sums[~fit] = 0
                groups, done = own.groups, 0
                digests = []
                for ok, n in zip(fit.tolist(), size.tolist(), strict=True):
                    digests.append(hashlib.sha256(b"".join([groups[u] for u in unit[done : done + n].tolist()])[:-1]).hexdigest() if ok else "")
                    done += n
                d = 0  # a batch may go over several blocks
                while d < len(cut):
                    room = np.cumsum(size[d : d + BLOCK - block.n]) + block.n_units
                    n = max(int(np.searchsorted(room, BLOCK_UNITS, side="right")), int(not block.n))
                    if n:
                        own_docs = slice(d, d + n)
                        at = (doc >= d) & (doc < d + n) & fit[doc]
                        block.add(own, doc[at] - d + block.n, unit[at])
                        yield batch(n, block=pa.array(np.full(n, block.number), pa.int64()), place=pa.array(np.arange(block.n, block.n + n), pa.int32()), doc_id=ids.slice(d, n), groups_sha256=pa.array(digests[own_docs]), **{c: pa.array(sums[own_docs, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
                        block.n, block.n_units, d = block.n + n, block.n_units + int(size[own_docs].sum()), d + n
                    if d < len(cut) or block.n == BLOCK:
                        yield from flush(block)
                        block = Block(block.number + 1)
        yield from flush(block)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _STRUCTURE)


def pair_scores(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, count, best) of every id pair from the popcounts of :func:`aligned`'s bitmaps: the pair's documents and links, and whether its B id has no pair with more links.

    ``pair`` is the A id times 65,536 plus the B id.
    """
    links = F.col("n") * F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")
    pairs = rows.where("pair is not null").groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(links).alias("count"))
    most = pairs.groupBy((F.col("pair") % 65536).alias("b")).agg(F.max("count").alias("most"))
    return pairs.join(most, F.col("pair") % 65536 == F.col("b")).select("pair", "n_docs", "count", (F.col("count") == F.col("most")).alias("best"))


def document_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Send the pairs' scores back along the bitmaps: one row for each document, with n_best and count_sum."""
    bitmaps = rows.where("pair is not null").select("block", "pair", "plane", "width", "bits").join(scores.select("pair", "count", "best"), "pair")
    documents = rows.where("pair is null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = documents.unionByName(bitmaps.drop("pair"), allowMissingColumns=True)

    def returned(table: pa.Table) -> pa.Table:
        mine = table.filter(pc.is_valid(table["place"]))
        maps = table.filter(pc.is_null(table["place"])).combine_chunks()
        total, best = np.zeros(BLOCK, dtype=np.int64), np.zeros(BLOCK, dtype=np.int64)
        for m in maps.to_batches(max_chunksize=50_000):
            bits = m["bits"]
            ends = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
            owner, place = places_of(int(m["width"][0].as_py()), np.diff(ends), bits.buffers()[2].to_pybytes()[ends[0] : ends[-1]])
            plane = m["plane"].to_numpy()
            times = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0).astype(np.int64))
            np.add.at(total, place, (times * m["count"].to_numpy())[owner])
            np.add.at(best, place, (times * m["best"].to_numpy(zero_copy_only=False))[owner])
        at = mine["place"].to_numpy()
        kept = mine.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(best[at])).append_column("count_sum", pa.array(total[at])).append_column("groups_sha256", mine["groups_sha256"])

    return both.groupBy("block").applyInArrow(returned, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Null and empty texts, and those whose bytes either vocabulary changes, have zeros and ''.
    Null and repeated ids are rows like any other; other columns of ``docs`` don't matter.
    """
    rows = materialize(aligned(docs, byte_path, piece_path), "aligned")
    return document_scores(rows, pair_scores(rows))
