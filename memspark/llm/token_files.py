"""Token ids in Arrow stream files of fixed-size-list batches.

A shard holds the ids of consecutive documents, cut into rows of ``SEQUENCE`` ids: one
``fixed_size_list`` column of ids and one of masks (false on the padding of the last row). All
rows are equally long, so a batch's values are one contiguous buffer and any range of ids is a
zero-copy slice of it. Beside each shard, ``docs-*.arrow`` holds each document's first id and
length within the shard. Shards follow ascending document ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memspark.session import scratch_path, ship_package

SEQUENCE = 2048
ROWS_PER_BATCH = 256
END_ID = 2
#: Words that a worker remembers with their ids; a full memory is emptied.
REMEMBERED = 1_200_000
#: Bytes of text that are split at once.
CHUNK = 8 << 20
# Letters that no Unicode version disputes and no normal form or small letter takes apart (as it does U+0130), and marks.
_QUICK = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-įı-ɏА-Яа-яЁё]+)(?P<tail>[.,!?;:#$%&*|]*)$"
_CODERS: dict[str, WordCoder] = {}


def _listed(words: pa.Array) -> list[str]:
    """As strings, by numpy: several times faster than ``to_pylist``."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordCoder:
    """Encodes texts word by word, remembering the ids of words seen before.

    Blanks and newlines end a token in this vocabulary and never become part of one, so the ids
    of a text are those of its words, one after the other. Words are numbered; the ids of word w
    are ``size[w]`` of ``flat`` from ``start[w]`` on.
    """

    SEPARATOR = "<|startoftext|>"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        vocabulary = self.coder.get_vocab()
        self.wide = self.coder.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.mark = self.coder.token_to_id(self.SEPARATOR)
        suffix = getattr(self.coder.model, "end_of_word_suffix", None)
        #: Whether an id ends a word; of a word of letters only the last one does.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number new words."""
        self.known.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size, self.flat = np.append(self.size, sizes), np.append(self.flat, ids)

    def _ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after the other, and how many each has."""
        n = self.size[words]
        return self.flat[np.repeat(self.start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def _ask(self, words: list[str]) -> None:
        """Ids of words from the tokenizer, many at a call with its own mark between them."""
        plain = [w for w in words if "<|" not in w]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.coder.encode(f" {self.SEPARATOR} ".join(part), add_special_tokens=False).ids, dtype=self.dtype)
            cuts = ids == self.mark
            self._put(part, ids[~cuts], np.bincount(np.cumsum(cuts)[~cuts], minlength=len(part)))
        for w in words:
            if "<|" in w:
                ids = np.array(self.coder.encode(w, add_special_tokens=False).ids, dtype=self.dtype)
                self._put([w], ids, np.array([len(ids)]))

    def _ask_letters(self, words: list[str]) -> None:
        """Ids of words of letters only: each ends at the only id that ends a word."""
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.coder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):
                self._put(part, ids, np.diff(last, prepend=-1))
            else:
                self._ask(part)

    def _numbers(self, words: pa.Array, ask, most: float = float("inf")) -> np.ndarray:
        """The numbers of different words; ``ask`` gets those not known yet. Beyond ``most`` words, all others go."""
        listed = _listed(words)
        found = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(found < 0)
        if len(self.known) + len(new) > most:
            self._forget()
            new = np.arange(len(listed))
        if len(new):
            ask(words.take(pa.array(new)))
            found[new] = np.fromiter(map(self.known.__getitem__, map(listed.__getitem__, new.tolist())), np.int64, len(new))
        return found

    def _learn(self, words: pa.Array) -> None:
        """Learn words; letters and the closing marks after them are separate tokens, and case is lost."""
        cut = pc.extract_regex(words, _QUICK)
        quick = cut.is_valid()
        self._ask(_listed(words.filter(pc.invert(quick))))
        words, cut = words.filter(quick), cut.filter(quick)
        if not len(words):
            return
        cores, tails = pc.ascii_lower(cut.field("core")).dictionary_encode(), cut.field("tail").dictionary_encode()
        core = self._numbers(cores.dictionary, lambda x: self._ask_letters(_listed(x)))[cores.indices.to_numpy()]
        tail = self._numbers(tails.dictionary, lambda x: self._ask(_listed(x)))[tails.indices.to_numpy()]
        other = pc.not_equal(words, cores.dictionary.take(cores.indices)).to_numpy(zero_copy_only=False)
        both, n = self._ids(np.stack([core[other], tail[other]], 1).ravel())
        self._put(_listed(words.filter(pa.array(other))), both, n.reshape(-1, 2).sum(1))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, little-endian."""
        texts, out = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), []
        upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            split = pc.split_pattern(pc.replace_substring(texts.slice(a, z - a), "\n", " "), " ")
            coded = split.flatten().dictionary_encode()
            ids, n = self._ids(self._numbers(coded.dictionary, self._learn, REMEMBERED)[coded.indices.to_numpy()])
            words = np.cumsum(pc.list_value_length(split).to_numpy())
            ends = np.append(0, np.append(0, np.cumsum(n))[words]) * self.dtype.itemsize
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())]
        return out


def coder(path: str) -> WordCoder:
    """One coder for each worker."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


class ShardWriter:
    """Writes one shard; ``close`` gives the numbers of documents and ids."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, dtype: np.dtype, length: int = SEQUENCE) -> None:
        self.fs, self.length, self.dtype, self.tag = fs, length, dtype, uuid.uuid4().hex
        self.final = [f"{folder}/{kind}-{shard:06d}.arrow" for kind in ("ids", "docs")]
        self.temp = [f"{p}.{self.tag}" for p in self.final]
        fs.create_dir(folder, recursive=True)
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(p) for p in self.temp]
        self.out = ipc.new_file(self.sinks[0], self.schema)
        self.docs_out = ipc.new_file(self.sinks[1], self.docs_schema)
        self.held: list[bytes] = []
        self.held_bytes = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        size = self.dtype.itemsize
        n = np.array([len(x) // size for x in ids], dtype=np.int64)
        start = self.n_ids + np.cumsum(n) - n
        self.docs_out.write_batch(pa.record_batch([doc_ids, pa.array(start), pa.array(n)], schema=self.docs_schema))
        self.held += ids
        self.held_bytes += int(n.sum()) * size
        self.n_ids += int(n.sum())
        self.n_docs += len(ids)
        if self.held_bytes >= ROWS_PER_BATCH * self.length * size:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        block = self.length * ROWS_PER_BATCH
        flat = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        done = 0
        while len(flat) - done >= block or last and done < len(flat):
            part = flat[done : done + block]
            rows = -(-len(part) // self.length)
            ids, mask = np.zeros(rows * self.length, dtype=self.dtype), np.zeros(rows * self.length, dtype=bool)
            ids[: len(part)], mask[: len(part)] = part, True
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            done += len(part)
        self.held = [flat[done:].tobytes()]
        self.held_bytes = len(self.held[0])

    def close(self) -> tuple[int, int]:
        self._flush(True)
        for x in (self.out, self.docs_out, *self.sinks):
            x.close()
        for a, b in zip(self.temp, self.final, strict=True):  # a repeated task puts the same file in place
            self.fs.move(a, b)
        return self.n_docs, self.n_ids


class ShardReader:
    """Random access to the ids of one shard."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int) -> None:
        local = isinstance(fs, pafs.LocalFileSystem)
        self.open = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.ids = ipc.open_file(self.open(f"{folder}/ids-{shard:06d}.arrow"))
        self.docs = ipc.open_file(self.open(f"{folder}/docs-{shard:06d}.arrow"))
        self.length = self.ids.schema.field("ids").type.list_size
        self.at, self.values = -1, np.empty(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.values = k, self.ids.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)
        return self.values

    def slices(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Zero-copy pieces that make up ids start to start + n."""
        block = self.length * ROWS_PER_BATCH
        while n > 0:
            k, at = divmod(start, block)
            piece = self._batch(k)[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """One equal-length sequence and its mask."""
        k, at = divmod(row, ROWS_PER_BATCH)
        batch = self.ids.get_batch(k)
        return self._batch(k)[at * self.length : (at + 1) * self.length], batch.column(1)[at].values.to_numpy(zero_copy_only=False)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Encode every text and write the shards below ``folder`` (a URI that all executors share).

    Returns (shard, documents, ids, ids before the shard) of each shard that has documents, one
    for each partition at most. Null texts count as empty; rows of one id are ordered by text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), None
        fs, path = _open(folder)
        words = coder(tokenizer)
        tail = np.array([end_id], dtype=words.dtype).tobytes()
        for b in batches:
            if out is None:
                out = ShardWriter(fs, path, shard, words.dtype, length)
            out.add(b.column(0), [x + tail for x in words.encode(b.column(1))])
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    found = sorted(tuple(r) for r in rows.mapInArrow(write, "shard int, n_docs bigint, n_ids bigint").collect())
    before, out = 0, []
    for shard, n_docs, n_ids in found:
        out.append((shard, n_docs, n_ids, before))
        before += n_ids
    return out


def read_token_files(spark, folder: str, shards: list[tuple[int, int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files alone."""
    ship_package(spark)
    schema = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame([(s, b) for s, _, _, b in shards], "shard int, before bigint").repartition(len(shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for b in batches:
            for shard, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = ShardReader(fs, path, shard)
                for k in range(r.docs.num_record_batches):
                    d = r.docs.get_batch(k)
                    crc = []
                    for start, n in zip(d.column(1).to_numpy(), d.column(2).to_numpy(), strict=True):
                        c = 0
                        for piece in r.slices(int(start), int(n)):
                            c = zlib.crc32(piece.astype("<u4").tobytes(), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(d.column(1).to_numpy() + before), d.column(2), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files of all documents to the shared folder and read each document back from them."""
    folder = scratch_path(docs.sparkSession, "tokens")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, tokenizer, folder))
