"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most
``MAX_BITS`` = 2 bits share at least six of the eight, so every linked pair shares two of the four
two-byte cells. The index therefore posts each distinct fingerprint under its six pairs of cells
(32 bits each), pairs that meet there tally their shared positional bytes, those with fewer than
six are dropped, and the rest are verified by counting differing bits.

A posting list longer than ``MAX_POSTING`` is not paired. Its fingerprints take an exact linear
way: two fingerprints are within two bits of each other if and only if some 64-bit word is within
one bit of both, so each is posted under its 65 words at distance 0 or 1, and all that meet in one
word (65 at most) are linked to the smallest. No list of pairs grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from memspark.llm.components import connected_components
from memspark.llm.names import fresh
from memspark.session import drop_scratch, materialize, ship_package

MAX_BITS = 2
MIN_SHARED_BYTES = 8 - MAX_BITS
MAX_POSTING = 32
SHINGLE_WORDS = 3
SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included, A-Z lower-cased."""
    # bytes.lower() touches A-Z only and bytes.split() splits on 0x20 and 0x09-0x0D only.
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=len(w) - words + 1)


def majority_bits(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 where over half of them have it."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _CHUNK):
        part = np.ascontiguousarray(h[i : i + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash64(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit SimHash as a signed long; null counts as the empty text, whose fingerprint is zero."""
    for s in texts:
        yield pd.Series([majority_bits(shingle_hashes(t or "")) for t in s], dtype="int64")


def _byte(x: Column, p: int) -> Column:
    return F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _postings(prints: DataFrame) -> DataFrame:
    """(fp) -> (slot, cells, fp): a row for each of the six pairs of two-byte cells."""
    cell = [F.shiftrightunsigned("fp", 16 * c).bitwiseAND(F.lit(0xFFFF)) for c in range(4)]
    keys = [F.struct(F.lit(s).alias("slot"), F.shiftleft(cell[i], 16).bitwiseOR(cell[j]).alias("cells")) for s, (i, j) in enumerate(combinations(range(4), 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.cells", "fp")


def links(prints: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect all within two bits of each other."""
    index = _postings(prints)
    lists = index.groupBy("slot", "cells").agg(F.count("*").alias("n")).where("n > 1")
    posted = materialize(index.join(lists, ["slot", "cells"]), "postings")
    cold = posted.where(F.col("n") <= max_posting)
    pairs = (
        cold.select("slot", "cells", F.col("fp").alias("u"))
        .join(cold.select("slot", "cells", F.col("fp").alias("v")), ["slot", "cells"])
        .where(F.col("u") > F.col("v"))
        .where(shared_bytes(F.col("u"), F.col("v")) >= MIN_SHARED_BYTES)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
        .select("u", "v")
    )
    # Long lists: 65 words for each fingerprint, at most 65 fingerprints for each word.
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).astype(np.int64)))) for i in range(64)))
    hot = posted.where(F.col("n") > max_posting).select("fp").distinct()
    met = hot.select("fp", F.explode(near).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) of every row.

    Nulls and empty texts have fingerprint zero and link like any other. Repeated rows get one
    result row each. ``component_id`` is the smallest non-null id of the component (null if it
    has none). Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), simhash64(F.col(text_col)).alias("fp"))
    own = materialize(own, "fingerprints")
    prints = materialize(own.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    comp = connected_components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    linked = prints.join(comp, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("c"))
    by_print = prints.join(linked.select("fp", "root").join(least, "root").select("fp", "c"), "fp", "left")
    by_print = by_print.select("fp", F.coalesce("c", "least").alias("component_id"))
    return own.join(by_print, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# Near copies of word-shingle similarity 0.8 or more: wide fingerprints, then a prefix filter.

WIDE_WORDS = 5
SIMILARITY = 0.8
#: 512 bits, 64 positional bytes.
WIDE_BYTES = 64
#: Keys of four positional bytes each, drawn with a seed: long enough that unrelated texts of ten
#: billion seldom meet. A pair of similarity 0.9 shares a byte with probability 0.43 and meets under
#: some key in two cases of three; the pairs that never meet are left to the prefix filter.
WIDE_KEYS, KEY_BYTES = 32, 4
#: A pair of similarity 0.8 shares 17 of 64 bytes on average (standard deviation 3.5).
WIDE_SHARED = 8
#: Texts whose shingles are counted and ordered together (their number takes 10 bits), and how many shingles those may have.
_INDEX = 10
TOGETHER, TOGETHER_SHINGLES = 1 << _INDEX, 1 << 20
#: Texts of a part beyond which a shingle travels as a count; shingles that are counted together.
FEW, RANGE = 8, 1 << 20
#: Words whose hash a worker remembers; a full memory is emptied.
_REMEMBERED = 150_000
_U = np.uint64
_SCALE = np.array([int(x) | 1 for x in np.random.default_rng(SEED).integers(1, 1 << 63, 8)], dtype=np.uint64)
_AT = np.array([sorted(np.random.default_rng((SEED, k)).choice(WIDE_BYTES, KEY_BYTES, replace=False).tolist()) for k in range(WIDE_KEYS)])
_WORDS: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    if len(_WORDS) > _REMEMBERED:
        _WORDS.clear()
    h = _WORDS[word] = xxhash.xxh64_intdigest(word, SEED)
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct five-word shingles of a text (A-Z lower-cased), as 64-bit hashes of their words' hashes, ascending.

    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = _WORDS.get
    h = np.fromiter((known(w) or _word_hash(w) for w in words), dtype=np.uint64, count=len(words))
    wide = min(WIDE_WORDS, len(words))
    out = np.full(len(words) - wide + 1, wide, dtype=np.uint64)
    for k in range(wide):
        out = (out ^ h[k : len(h) - wide + 1 + k]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return np.unique(out)


def wide_majority(h: np.ndarray) -> bytes:
    """512 majority bits of distinct shingle hashes."""
    ones = np.zeros(WIDE_BYTES * 8, dtype=np.int64)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * _SCALE
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > max(len(h), 1), bitorder="little").tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row keys and text -> row keys, node (a hash of the shingle set), and for a node's first row in the batch its place, set and fingerprint.

    A place is a part and a number in it; a set is 32 bits of each shingle, ascending.
    """
    part, held, size = TaskContext.get().partitionId() << 20, 0, 0
    for b in batches:
        nodes, places, sets, prints, seen = [], [], [], [], set()
        for text in b.column(b.num_columns - 1).to_pylist():
            h = shingle_set(text)
            node = xxhash.xxh64_intdigest(h.tobytes(), SEED) >> 1
            nodes.append(node)
            if node in seen:
                for column in (places, sets, prints):
                    column.append(None)
                continue
            seen.add(node)
            if held == TOGETHER or size + len(h) > TOGETHER_SHINGLES:
                part, held, size = part + 1, 0, 0
            places.append(part << _INDEX | held)
            sets.append(np.unique((h >> _U(32)).astype(np.uint32).view(np.int32)))
            prints.append(wide_majority(h))
            held, size = held + 1, size + len(h)
        made = [pa.array(nodes, pa.int64()), pa.array(places, pa.int64()), pa.array(sets, pa.list_(pa.int32())), pa.array(prints, pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "node", "place", "s", "fp"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _wide_keys(prints: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The index keys of a wide fingerprint: number of the key and its positional bytes."""
    head = np.arange(WIDE_KEYS, dtype=np.int64) << 8 * KEY_BYTES
    for s in prints:
        b = np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, WIDE_BYTES).astype(np.int64)
        keys = head
        for k in range(KEY_BYTES):
            keys = keys | b[:, _AT[:, k]] << 8 * k
        yield pd.Series(list(keys))


@F.pandas_udf(T.IntegerType())
def _tally(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many positional bytes two wide fingerprints share."""
    x = np.frombuffer(b"".join(a), dtype=np.uint8) == np.frombuffer(b"".join(b), dtype=np.uint8)
    return pd.Series(x.reshape(len(a), -1).sum(1).astype(np.int32))


def _index_pairs(nodes: DataFrame) -> DataFrame:
    """(node, fp) -> pairs (u, v), u > v, that meet in the byte-position index and share WIDE_SHARED bytes.

    All nodes of a list meet its smallest one, so pairs are fewer than postings however long lists
    are; what that leaves out is found by the prefix filter.
    """
    index = materialize(nodes.select("node", F.explode(_wide_keys("fp")).alias("key")), "wide_index")
    lists = index.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    pairs = index.join(lists, "key").where("node > low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    left, right = nodes.toDF("u", "fu"), nodes.toDF("v", "fv")
    return pairs.join(left, "u").join(right, "v").where(_tally("fu", "fv") >= WIDE_SHARED).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets (node, m: their sizes, s: the shingles that others have too) have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("m").alias("mu"), F.col("s").alias("su")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("m").alias("mv"), F.col("s").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(shared >= F.lit(similarity) * (F.col("mu") + F.col("mv") - shared)).select("u", "v")


def _coded(shingle: np.ndarray, number: np.ndarray) -> bytes:
    """Ascending shingles as gaps, low and high halves apart, and a 16-bit number for each."""
    gap = np.diff(shingle, prepend=np.uint32(0)).astype(np.uint32)
    return gap.astype(np.uint16).tobytes() + (gap >> np.uint32(16)).astype(np.uint16).tobytes() + number.astype(np.uint16).tobytes()


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, dtype=np.uint16).reshape(3, -1)
    return np.cumsum(x[0].astype(np.uint32) | x[1].astype(np.uint32) << np.uint32(16), dtype=np.uint32), x[2].astype(np.int64)


_COUNTED = "bucket bigint, part bigint, data binary, often binary, nodes binary"


def _rows_of(bucket: list, part: list, data: list, often: list | None = None, nodes: list | None = None) -> pa.RecordBatch:
    none = [None] * len(bucket)
    arrays = [pa.array(bucket, pa.int64()), pa.array(part, pa.int64()), *(pa.array(none if x is None else x, pa.binary()) for x in (data, often, nodes))]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "part", "data", "often", "nodes"])


def _by_bucket(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, node, s) -> for each part a row for each range of shingles, and one of its own with its nodes.

    A row lists shingles with the number of the text that has each; of a shingle that over FEW texts
    have it holds the count, above the numbers, and the texts stand in the part's own row.
    """
    for b in batches:
        place, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        for part in np.unique(place >> _INDEX).tolist():
            own = np.flatnonzero(place >> _INDEX == part)
            sets = b.column(2).take(pa.array(own))
            size = np.diff(sets.offsets.to_numpy())
            shingle = sets.flatten().to_numpy().view(np.uint32)
            number = np.repeat(place[own] & TOGETHER - 1, size)
            order = np.argsort(shingle, kind="stable")
            shingle, number = shingle[order], number[order]
            first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(shingle)))
            many = np.repeat(n > FEW, n)
            apart = _coded(shingle[many], number[many])
            keep = ~many
            keep[first[n > FEW]] = True
            number[first[n > FEW]] = TOGETHER - 1 + n[n > FEW]
            shingle, number = shingle[keep], number[keep]
            bucket = shingle.astype(np.int64) >> 32 - bits
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
            ends = np.append(cut[1:], len(bucket))
            names = np.stack([place[own], node[own], size]).astype(np.int64).tobytes()
            yield _rows_of([-1 - part], [part], [apart], None, [names])
            if len(cut):
                yield _rows_of(bucket[cut].tolist(), [part] * len(cut), [_coded(shingle[i:j], number[i:j]) for i, j in zip(cut, ends, strict=True)])


def _shared_of_bucket(rows: pa.Table) -> pa.Table:
    """A range's rows -> the shingles that several texts have, with their count; a part's own row passes."""
    if rows.column("bucket")[0].as_py() < 0:
        return rows
    found = [_decoded(x) for x in rows.column("data").to_pylist()]
    shingle, number = (np.concatenate(x) for x in zip(*found, strict=True))
    of = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    order = np.argsort(shingle, kind="stable")
    ranked = shingle[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    weight = np.where(number < TOGETHER, 1, number - TOGETHER + 1)[order]
    often = np.empty(len(order), np.int64)
    often[order] = np.repeat(np.add.reduceat(weight, first), np.diff(np.append(first, len(order))))
    some = often > 1
    shingle, number, often, of = shingle[some], number[some], np.minimum(often[some], 0xFFFFFFFF).astype(np.uint32), of[some]
    at = np.searchsorted(of, np.arange(len(found) + 1))
    held = [k for k in range(len(found)) if at[k + 1] > at[k]]
    part = rows.column("part").to_pylist()
    out = _rows_of([0] * len(held), [part[k] for k in held], [_coded(shingle[at[k] : at[k + 1]], number[at[k] : at[k + 1]]) for k in held], [often[at[k] : at[k + 1]].tobytes() for k in held])
    return pa.Table.from_batches([out])


def _ordered(rows: pa.Table) -> pa.Table:
    """A part's rows -> its nodes with the sizes of their sets and their shared shingles, the rarest first."""
    found = [(*_decoded(d), np.frombuffer(o, dtype=np.uint32).astype(np.int64)) for d, o in zip(rows.column("data").to_pylist(), rows.column("often").to_pylist(), strict=True) if o is not None]
    own = [x for x in zip(rows.column("nodes").to_pylist(), rows.column("data").to_pylist(), strict=True) if x[0] is not None]
    names = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(3, -1) for x, _ in own], axis=1)
    apart = [_decoded(x) for _, x in own]
    empty = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    shingle, number, often = (np.concatenate(x) for x in zip(empty, *found, strict=True))
    single = number < TOGETHER
    # Frequent shingles of the part: every text that has one, with the count that came back.
    by = np.argsort(shingle[~single], kind="stable")
    known, count = shingle[~single][by], often[~single][by]
    more, texts = (np.concatenate(x) for x in zip(empty[:2], *apart, strict=True))
    at = np.searchsorted(known, more)
    shingle = np.concatenate([shingle[single], more])
    number = np.concatenate([number[single], texts])
    often = np.concatenate([often[single], count[at]])
    order = np.lexsort((shingle, often, number))
    shingle = shingle[order].view(np.int32)
    begin = np.searchsorted(number[order], np.arange(TOGETHER + 1))
    sets = [shingle[begin[k] : begin[k + 1]] for k in (names[0] & TOGETHER - 1).tolist()]
    table = pa.table({"node": pa.array(names[1]), "m": pa.array(names[2].astype(np.int32)), "s": pa.array(sets, pa.list_(pa.int32()))})
    return table.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))


def _shared_sets(own: DataFrame) -> DataFrame:
    """(place, node, s) -> (node, m, s): sizes of shingle sets and those of their shingles that others have too, rarest first.

    Shingles are ordered by how many sets have them, then by hash. They are counted in ranges of
    about RANGE shingles, whose number grows with the data; a part lists a range's shingles in one
    row, and a frequent one as a count, so it is a few bytes for each part.
    """
    total = own.agg(F.sum(F.size("s").cast("bigint"))).first()[0] or 0
    bits = min(32, max(1, (total // RANGE).bit_length()))
    counted = own.select("place", "node", "s").mapInArrow(partial(_by_bucket, bits), _COUNTED)
    shared = counted.groupBy("bucket").applyInArrow(lambda t: _shared_of_bucket(t), _COUNTED)
    found = shared.groupBy("part").applyInArrow(lambda t: _ordered(t), "node bigint, m int, s array<int>")
    return found.dropDuplicates(["node"])


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, m, s) -> (shingle, x: node, m, i): each set's rarest shingles as far as others have them, with their places.

    Two sets of similarity t share at least t times the larger one's size, so they meet in the
    first m - ceil(t m) + 1 of each, of which those that no other set has come first.
    """
    alone = F.col("m") - F.size("s")
    length = F.col("m") - F.ceil(F.lit(similarity) * F.col("m") - 1e-6) + 1 - alone
    each = sets.where(length > 0).select("node", "m", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("i", "shingle"))
    return each.select("shingle", F.struct("node", "m", (F.col("i") + F.col("alone") + 1).alias("i")).alias("x"))


def _may_link(u: str, v: str, similarity: float) -> Column:
    """Whether two sets that meet at a shingle can still share enough: by their sizes and by what follows the shingle in each."""
    mu, iu, mv, iv = (F.col(f"{x}.{c}") for x in (u, v) for c in ("m", "i"))
    sizes = F.least(mu, mv) >= F.lit(similarity) * F.greatest(mu, mv) - 1e-6
    left = F.least(mu - iu, mv - iv) + 1
    return sizes & (left >= F.lit(similarity / (1 + similarity)) * (mu + mv) - 1e-6)


def _apart(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Lists (shingle, x: node, m, i) with each node's part, less the lists that one part holds."""
    named = lists.withColumn("part", F.col("x.node")) if parts is None else lists.withColumn("node", F.col("x.node")).join(parts, "node", "left").select("shingle", "x", F.coalesce("root", "node").alias("part"))
    kinds = named.groupBy("shingle").agg(F.count("*").alias("n"), F.min_by("x", F.struct(F.col("x.i") / F.col("x.m"), F.col("x.node"))).alias("low"), F.min("part").alias("p"), F.max("part").alias("q"))
    return named.join(kinds.where("p <> q").select("shingle", "n", "low"), "shingle")


def _completed(sets: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Verified links (u, v) that, with the known ones, join all sets (node, m, s) of the similarity or more.

    Sets meet under the shared shingles of their prefixes, and only where they are in different
    components yet. Lists up to MAX_POSTING meet in pairs. In a longer one all first meet the set
    with the fewest shingles before it; then those that are in different components still meet in
    pairs. A pair goes to verification only if sizes and places leave room for the similarity.
    """
    prefix = _prefixes(sets, similarity)
    comp = materialize(connected_components(known), "components")
    lists = materialize(_apart(prefix, comp), "prefix_lists")
    short, long = lists.where(F.col("n") <= MAX_POSTING), lists.where(F.col("n") > MAX_POSTING)
    pair = (F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))
    a, b = (short.select("shingle", F.col("x").alias(c), F.col("part").alias(f"p{c}")) for c in "ab")
    met = a.join(b, "shingle").where("pa < pb").where(_may_link("a", "b", similarity)).select(*pair)
    stars = long.select(F.col("x").alias("a"), F.col("low").alias("b")).where("a.node <> b.node").where(_may_link("a", "b", similarity)).select(*pair)
    first = materialize(met.union(stars).distinct(), "prefix_pairs")
    found = materialize(_verified(first, sets, similarity), "prefix_links")
    comp = materialize(connected_components(known.union(found)), "components")
    rest = materialize(_apart(long.select("shingle", "x"), comp), "prefix_lists")
    sizes = rest.groupBy("shingle", "part").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("part", F.struct("c", "part")).alias("most"))
    split = rest.join(sizes, "shingle")
    # Pairs of two small parts meet once; those of a small part and the largest one meet from the small one.
    a = split.where("part <> most").select("shingle", F.col("x").alias("a"), F.col("part").alias("pa"))
    b = split.select("shingle", F.col("x").alias("b"), F.col("part").alias("pb"), (F.col("part") == F.col("most")).alias("largest"))
    last = a.join(b, "shingle").where("largest or pa < pb").where(_may_link("a", "b", similarity)).select(*pair).distinct()
    last = materialize(last.join(first, ["u", "v"], "left_anti"), "rest_pairs")
    return found.union(_verified(last, sets, similarity))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less near copies: of each group the row with the smallest id stays.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles (A-Z
    lower-cased) is at least ``similarity``, and groups are what links connect. Candidates come from
    the byte-position index over 512-bit fingerprints, by count of shared bytes, and are verified on
    the whole sets; links between groups that the index doesn't show are found by a prefix filter
    over the sets, which is exact. Equal sets are one node.
    Null and empty texts are equal texts. Null ids count as larger than all others; of rows of a
    group that repeat its smallest id, the one with the smallest hash of its text stays. Rows are
    told apart by id and text, so different texts under one id, or under none, are judged each, and
    of rows that repeat both one stays. All columns are kept, whatever their names.
    """
    ship_package(docs.sparkSession)
    row = [F.col(id_col).isNull().alias("unnamed"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("hash")]
    own = docs.select(*row, F.col(text_col).alias("text")).mapInArrow(_sets, "unnamed boolean, id bigint, hash bigint, node bigint, place bigint, s array<int>, fp binary")
    own = materialize(own, "shingle_sets")
    least = materialize(own.groupBy("node").agg(F.min(F.struct("unnamed", "id", "hash")).alias("row"), F.max("fp").alias("fp")), "nodes")
    sets = materialize(_shared_sets(own.where("s is not null")), "shared_sets")
    drop_scratch(own)
    pairs = materialize(_index_pairs(least.select("node", "fp")), "index_pairs")
    linked = materialize(_verified(pairs, sets, similarity), "links")
    linked = materialize(linked.union(_completed(sets, linked, similarity)), "links")
    comp = connected_components(linked).withColumnRenamed("root", "group")
    grouped = least.select("node", "row").join(comp, "node", "left").withColumn("group", F.coalesce("group", "node"))
    stays = materialize(grouped.groupBy("group").agg(F.min("row").alias("row")).select("row.*"), "stays")
    for done in (sets, least, linked):
        drop_scratch(done)
    keys = fresh(docs, "unnamed", "id", "hash")
    kept = docs.select("*", *(c.alias(k) for c, k in zip(row, keys, strict=True))).join(stays.toDF(*keys), keys, "left_semi")
    return kept.dropDuplicates(keys).drop(*keys)
