"""Removal of repeated passages by prefix-free parsing.

A rolling hash triggers phrase ends: of all ``GRAM``-byte grams of a ``WINDOW``-byte string, the
one with the smallest mixed hash (the first of equals) is its trigger, so every string has one and
equal strings have it in the same place. Consecutive strings of a document with one trigger form a
phrase, which overlaps its neighbours. The *parse* is the sequence of phrase hashes in document
order, the *dictionary* holds each distinct phrase with its earliest document.

An occurrence of a phrase after its earliest one repeats in all its strings; that settles most of
a repetitive corpus without looking at strings. Strings of different phrases can only be equal if
the phrases have the same trigger, so only dictionary phrases whose trigger has several phrases
are taken apart. The phrases of one trigger meet as bytes, and a suffix array of such a block of the
dictionary, cut at ``WINDOW`` bytes and with equal suffixes in the corpus order that the parse gives
them, shows which strings repeat: in a run of equal ones each but the first. Phrases of a trigger
with more than ``HOT`` rows are dealt out as single strings, by two hashes of 127 bits, instead.

Every task first settles what repeats among its own rows, so a passage that very many documents
share reaches the shuffle once for each batch of rows. A trigger with many different phrases in
one batch is dealt out by phrase instead of by trigger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from memspark.session import materialize, ship_package

WINDOW = 100
GRAM = 32
#: Phrases of one trigger in one batch beyond which they are dealt out by phrase.
MANY = 16
#: Rows of one trigger beyond which its phrases are taken apart before they meet.
HOT = 2_000
#: Phrases, and bytes of them, that a task takes apart at once; a key's phrases stay together.
BLOCK, BLOCK_BYTES = 20_000, 1 << 20
_POSITION = 20
_CHUNK = 1 << _POSITION
_U = np.uint64
_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
_REPEATS, _PHRASE, _SPREAD, _NOTE = 1, 0, 2, 3


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            p = np.full(_CHUNK + 1, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return h ^ h >> _U(29)


def _sums(buffer: bytes) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    b = np.frombuffer(buffer, dtype=np.uint8)
    s = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * _powers()[0][: len(b)], out=s[1:])
    return s


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into buffers of at most 2^20 bytes: buffer, starts, lengths, owners, offsets in the owner.

    A longer text is cut into pieces that overlap by window - 1 bytes, so no string is lost.
    """
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def out() -> tuple:
        n = np.array([len(x[0]) for x in held], dtype=np.int64)
        return b"".join(x[0] for x in held), np.cumsum(n) - n, n, np.array([x[1] for x in held]), np.array([x[2] for x in held])

    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), _CHUNK - window + 1):
            part = t[at : at + _CHUNK]
            if len(part) < window:
                continue
            if size + len(part) > _CHUNK:
                yield out()
                held, size = [], 0
            held.append((part, k, at))
            size += len(part)
    if held:
        yield out()


def _phrases(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Rows (owner, first string, strings, trigger hash, phrase hash) of texts, in text order."""
    found = []
    for buffer, starts, lengths, owners, offsets in _pieces(texts, window):
        s, q = _sums(buffer), _powers()[1]
        n = len(buffer)
        g = _mixed((s[gram:] - s[:-gram]) * q[: n - gram + 1])
        m = g >> _U(_POSITION) << _U(_POSITION) | np.arange(len(g), dtype=np.uint64)
        wide, reach = 1, window - gram + 1
        while wide * 2 <= reach:
            m = np.minimum(m[:-wide], m[wide:])
            wide *= 2
        if reach > wide:
            m = np.minimum(m[: n - window + 1], m[reach - wide :])
        count = lengths - window + 1
        own = np.repeat(np.arange(len(count)), count)
        p = np.arange(len(own)) + np.repeat(starts - (np.cumsum(count) - count), count)
        at = (m[p] & _U(_CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]))))
        strings = np.diff(np.append(first, len(p)))
        lo, doc = p[first], own[first]
        found.append(np.stack([owners[doc].astype(np.uint64), (lo - starts[doc] + offsets[doc]).astype(np.uint64), strings.astype(np.uint64), g[at[first]], (s[lo + strings - 1 + window] - s[lo]) * q[lo]]))
    return np.concatenate(found, axis=1) if found else np.zeros((5, 0), dtype=np.uint64)


def suffix_ranks(buffer: bytes, window: int = WINDOW) -> np.ndarray:
    """The rank of each whole ``window``-byte string of a buffer among all of them, equal ones alike.

    Ranks of 8 bytes come from the bytes as big-endian numbers; ranks of two adjoining or overlapping
    halves give those of the whole.
    """
    n = len(buffer) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    raw = np.frombuffer(buffer, dtype=np.uint8)
    wide = min(8, window)
    value = np.zeros(len(raw) - wide + 1, dtype=np.uint64)
    for k in range(wide):
        value = value << _U(8) | raw[k : len(raw) - wide + 1 + k]
    rank = np.unique(value, return_inverse=True)[1]
    while wide < window:
        step = min(wide, window - wide)
        rank = np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        wide += step
    return rank


def _strings(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, hash) of all strings of texts, in order."""
    parts = []
    for buffer, starts, lengths, owners, offsets in _pieces(texts, window):
        s, q = _sums(buffer), _powers()[1]
        count = lengths - window + 1
        own = np.repeat(np.arange(len(count)), count)
        p = np.arange(len(own)) + np.repeat(starts - (np.cumsum(count) - count), count)
        parts.append((owners[own], p - starts[own] + offsets[own], (s[p + window] - s[p]) * q[p]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _packed(owner: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of string starts, sorted by owner and start: adjoining ones joined and packed."""
    if not len(owner):
        return owner, np.empty(0, np.int64)
    cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (lo[1:] != lo[:-1] + n[:-1])))
    at = np.flatnonzero(cut)
    total = np.add.reduceat(n, at)
    if total.max() > 0xFFFFFF:
        return owner, lo << 24 | n
    return owner[at], lo[at] << 24 | total


_ROW = "key bigint, phrase bigint, d bigint, tie bigint, span bigint, kind tinyint"


def _rows(key: np.ndarray, phrase: np.ndarray, d: np.ndarray, tie: np.ndarray, span: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in (key, phrase, d, tie, span)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(kind.astype(np.int8))], names=["key", "phrase", "d", "tie", "span", "kind"])


def _ordered(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """A batch's documents in corpus order, each once: ids, ties, texts, positions in the batch."""
    d, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
    order = np.lexsort((tie, d))
    keep = np.concatenate(([True], (np.diff(d[order]) != 0) | (np.diff(tie[order]) != 0))) if len(order) else np.empty(0, bool)
    order = order[keep]
    texts = b.column(2).cast(pa.binary()).take(pa.array(order)).to_pylist()
    return d[order], tie[order], texts, order


def _earliest(value: np.ndarray) -> np.ndarray:
    """True where a value appears first; rows are in corpus order."""
    first = np.zeros(len(value), dtype=bool)
    first[np.unique(value, return_index=True)[1]] = True
    return first


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of a batch: those that repeat an earlier one of the batch are settled at once."""
    for b in batches:
        d, tie, texts, _ = _ordered(b)
        owner, lo, n, trigger, phrase = _phrases(texts)
        if not len(owner):
            continue
        owner, lo, n = owner.astype(np.int64), lo.astype(np.int64), n.astype(np.int64)
        trigger = trigger >> _U(24)  # 40 bits deal out well; the phrase hash tells phrases apart
        first = _earliest(phrase)
        own, span = _packed(owner[~first], lo[~first], n[~first])
        if len(own):
            yield _rows(_mixed(span.astype(np.uint64) ^ d[own].astype(np.uint64)) >> _U(24), np.zeros(len(own), np.int64), d[own], tie[own], span, np.full(len(own), _REPEATS))
        owner, lo, n, trigger, phrase = owner[first], lo[first], n[first], trigger[first], phrase[first]
        _, at, count = np.unique(trigger, return_inverse=True, return_counts=True)
        many = count[at] > MANY
        key = np.where(many, _mixed(trigger ^ phrase) >> _U(24), trigger)
        yield _rows(key, phrase, d[owner], tie[owner], lo << 24 | n, np.where(many, _SPREAD, _PHRASE))
        if many.any():
            noted = np.unique(trigger[many])
            zero = np.zeros(len(noted), np.int64)
            yield _rows(noted, zero, zero, zero, zero, np.full(len(noted), _NOTE))


_PART = "key bigint, d bigint, tie bigint, span bigint, bytes binary"
#: The key of strings that are settled already.
_SETTLED = -1


def _parts(key: np.ndarray, d: np.ndarray, tie: np.ndarray, span: np.ndarray, data: list | None) -> pa.RecordBatch:
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in (key, d, tie, span)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(data if data is not None else [None] * len(key), pa.binary())], names=["key", "d", "tie", "span", "bytes"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked phrases of a batch's documents as bytes; those of hot triggers as single strings.

    Of a hot trigger's strings, those that repeat an earlier one of the batch come back settled.
    """
    for b in batches:
        d, tie, texts, order = _ordered(b)
        asked = b.column(3).take(pa.array(order)).to_pylist()
        cold, hot = ([], [], []), ([], [], [])
        for k, (text, phrases) in enumerate(zip(texts, asked, strict=True)):
            for x in sorted(phrases, key=lambda x: x["span"]):
                lo, n = x["span"] >> 24, x["span"] & 0xFFFFFF
                to = hot if x["hot"] else cold
                to[0].append(k)
                to[1].append(x["span"] if x["hot"] else (x["key"], x["span"]))
                to[2].append(text[lo : lo + n - 1 + WINDOW])
        if cold[0]:
            at, ks = np.array(cold[0]), np.array(cold[1], dtype=np.int64)
            yield _parts(ks[:, 0], d[at], tie[at], ks[:, 1], cold[2])
        if hot[0]:
            at, lo = np.array(hot[0]), np.array(hot[1], dtype=np.int64) >> 24
            own, start, value = _strings(hot[2])
            doc, value = at[own], value & _U(2**63 - 1)
            first = _earliest(value)
            check = [xxhash.xxh64_digest(hot[2][o][p : p + WINDOW]) for o, p in zip(own[first].tolist(), start[first].tolist(), strict=True)]
            start = lo[own] + start
            who, span = _packed(doc[~first], start[~first], np.ones(int((~first).sum()), np.int64))
            yield _parts(np.full(len(who), _SETTLED), d[who], tie[who], span, None)
            yield _parts(value[first], d[doc[first]], tie[doc[first]], start[first] << 24 | 1, check)


def _later(rows: pa.Table) -> pa.RecordBatch | None:
    """Of rows that hold all of their keys: spans of strings that repeat an earlier one.

    Rows hold a phrase's bytes, or for a single string a second hash of 8 bytes.
    """
    key, d, tie, span = (rows.column(i).to_numpy() for i in range(4))
    order = np.lexsort((key, span, tie, d))
    twice = np.all([np.diff(x[order]) == 0 for x in (key, d, tie, span)], axis=0)
    order = order[np.concatenate(([True], ~twice))]
    key, d, tie, span = key[order], d[order], tie[order], span[order]
    doc = np.concatenate(([0], np.cumsum((np.diff(d) != 0) | (np.diff(tie) != 0))))
    data = rows.column(4).take(pa.array(order)).to_pylist()
    size = np.array([len(x) for x in data], dtype=np.int64)
    lone, phrase = np.flatnonzero(size < WINDOW), np.flatnonzero(size >= WINDOW)
    pairs = np.stack([key[lone], np.frombuffer(b"".join(data[i] for i in lone.tolist()), dtype="<i8")])
    single = np.unique(pairs, axis=1, return_inverse=True)[1].ravel() if len(lone) else np.empty(0, np.int64)
    # All whole strings of the phrases, laid end to end; those over a phrase's end are left out.
    rank = suffix_ranks(b"".join(data[i] for i in phrase.tolist()))
    beyond = len(rank)
    count = size[phrase] - WINDOW + 1
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    rank = rank[nth + np.repeat(np.cumsum(size[phrase]) - size[phrase], count)]
    own = np.concatenate([np.repeat(phrase, count), lone])
    start = (span >> 24)[own] + np.concatenate([nth, np.zeros(len(lone), np.int64)])
    value = np.concatenate([rank, single + beyond])  # phrases and single strings never share a key
    order = np.lexsort((start, doc[own], value))  # the suffix array, equal suffixes in corpus order
    repeat = order[1:][value[order[1:]] == value[order[:-1]]]
    if not len(repeat):
        return None
    repeat = repeat[np.lexsort((start[repeat], doc[own[repeat]]))]
    again = np.ones(len(repeat), bool)  # a string that two phrases of one document hold is one
    again[1:] = (doc[own[repeat[1:]]] != doc[own[repeat[:-1]]]) | (start[repeat[1:]] != start[repeat[:-1]])
    repeat = repeat[again]
    who, packed = _packed(doc[own[repeat]], start[repeat], np.ones(len(repeat), np.int64))
    at = np.searchsorted(doc, who)
    return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(tie[at]), pa.array(packed)], names=["d", "tie", "span"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: settled ones pass, whole keys of others are taken a bounded block at a time."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        done = int((b.column(0).to_numpy() == _SETTLED).sum())  # they sort first
        if done:
            yield pa.RecordBatch.from_arrays([b.column(i).slice(0, done) for i in (1, 2, 3)], names=["d", "tie", "span"])
        for at in range(done, b.num_rows, 256):
            part = b.slice(at, 256)
            held.append(part)
            n += part.num_rows
            size += pc.sum(pc.binary_length(part.column(4))).as_py() or 0
            if n < BLOCK and size < BLOCK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut and (out := _later(rows.slice(0, cut).combine_chunks())) is not None:
                yield out
            rest = rows.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
            size = pc.sum(pc.binary_length(rest.column(4))).as_py() or 0
    if n and (out := _later(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield out


def repeated_spans(own: DataFrame) -> DataFrame:
    """(d, tie, text, ...) -> (d, tie, spans): packed spans of the string starts that repeat."""
    parsed = own.select("d", "tie", "text").mapInArrow(_parse, _ROW).repartition("key")
    place, note = F.struct("d", "tie", "span"), F.col("kind") == _NOTE
    earliest = F.min(F.when(~note, place)).over(Window.partitionBy("key", "phrase"))
    several = Window.partitionBy("key")
    noted = F.max(note.cast("int")).over(several) == 1
    parsed = parsed.withColumn("later", ~note & (place > earliest))
    parsed = parsed.withColumn("asks", noted | (F.min("phrase").over(several) != F.max("phrase").over(several)))
    parsed = parsed.withColumn("hot", noted | (F.count("*").over(several) > HOT) | (F.col("kind") == _SPREAD))
    repeats = (F.col("kind") == _REPEATS) | F.col("later")
    asks = (F.col("kind") == _SPREAD) | ((F.col("kind") == _PHRASE) & F.col("asks"))
    settled = parsed.select("d", "tie", "span", F.when(repeats, F.lit(False)).when(asks, F.lit(True)).alias("ask"), F.when(~repeats, F.col("key")).alias("key"), "hot").where("ask is not null")
    settled = materialize(settled, "phrases")
    asked = settled.where("ask").groupBy("d", "tie").agg(F.collect_list(F.struct("span", "key", "hot")).alias("asked"))
    # All columns of the documents go along, so that the last join reads the same exchange again.
    rest = [c for c in own.columns if c not in ("d", "tie", "text")]
    parts = own.join(asked, ["d", "tie"]).select("d", "tie", "text", "asked", *rest).mapInArrow(_suffixes, _PART)
    dealt = F.when(F.col("key") == _SETTLED, F.xxhash64("d", "span")).otherwise(F.col("key"))
    again = parts.repartition(dealt).sortWithinPartitions("key").mapInArrow(_meet, "d bigint, tie bigint, span bigint")
    return settled.where("not ask").select("d", "tie", "span").union(again).groupBy("d", "tie").agg(F.collect_list("span").alias("spans"))


def removed_runs(spans: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Maximal runs (start, end) of covered bytes, one row each."""
    if not len(spans):
        return np.zeros((0, 2), dtype=np.int64)
    spans = np.sort(spans)
    lo, hi = spans >> 24, (spans >> 24) + (spans & 0xFFFFFF) - 1 + window
    top = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > top[:-1]))
    at = np.flatnonzero(new)
    return np.stack([lo[at], np.append(top[at[1:] - 1], top[-1])], axis=1)


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    return b"".join(text[a:z] for a, z in zip(np.append(0, runs[:, 1]), np.append(runs[:, 0], len(text)), strict=True))


def whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs narrowed so that no UTF-8 character is cut; runs that vanish are dropped."""
    out = []
    for a, z in runs.tolist():
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append((a, z))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _finish(kept_names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True):
            runs = removed_runs(np.asarray(spans if spans is not None else [], dtype=np.int64))
            kept = kept_bytes(text, runs) if len(runs) else text
            whole = kept_bytes(text, whole_characters(text, runs)) if len(runs) else text
            rows.append((len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(), whole.decode("utf-8", "replace")))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns[2:], *made], names=[*kept_names, *names])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row.

    Each byte covered by a WINDOW-byte string that also starts earlier (in a smaller id, or earlier
    in the same text) is removed. Null texts count as empty; null ids come before all others; rows
    of one id are ordered by a hash of their text, and rows that repeat both id and text are one
    document, with the result on each. ``kept_text`` leaves characters whole: bytes of a character
    that is only partly removed stay in it, while n_removed and kept_sha256 count exact bytes.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Ties only matter where an id has several rows.
    several = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    tie = F.lit(0).cast("bigint") if several.isEmpty() else F.xxhash64(text)
    own = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("d"), tie.alias("tie"), text.alias("text"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    spans = repeated_spans(own)
    types = docs.schema
    flat = own.join(spans, ["d", "tie"], "left").select("text", "spans", "_id", *(f"_keep{i}" for i in range(len(keep))))
    schema = T.StructType([types[id_col], *(types[c] for c in keep)])
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())):
        schema = schema.add(name, kind)
    return flat.mapInArrow(partial(_finish, [id_col, *keep]), schema)
