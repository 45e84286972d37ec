"""Spelling variants by a relational walk over tries, level by level.

Words that differ in one place agree in the half before it or in the half after it. So there are
two tries of every word length, one of the words read forwards and one of them read backwards, and
a word enters each at the node of its own half: in state (word, position, node, edits) with no edit
yet. The edge table holds (trie, node, letter, next letter); states join it on node and the letter
after the next, which spends the edit on another child (a replacement), or step over a letter into
the trie of the next shorter words (a deletion). States with their edit spent join the node table
level by level until they stand on a word's last letter; those words are neighbours. An insertion
is a deletion seen from the longer word. Since a node exists only if all above it do, the strides
between levels grow: 1, 2, 4, ... letters.

Words of over ``LONG`` letters are rare and would have that many levels: their gapped hashes meet
instead (one for each place), and each pair is compared letter by letter.

Both sides of every join grow with the words, and one plan holds all levels: broadcasts of a few MB,
many of which would be alive at once, fill a driver. So all joins are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memspark.session import drop_scratch, materialize, ship_package

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
LONG = 48
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, with every 199th (document, run) short of one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    hashed = runs.select(run.alias("run"), F.crc32(F.concat("doc", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast, however small a side seems."""
    return left.join(right.hint("merge"), on, how)


def _cut(s: str, first: Column, n: Column) -> Column:
    return F.substring(F.col(s), first, n)


def _by_levels(words: DataFrame) -> DataFrame:
    """(word, near) of each pair of words, once: ``near`` is as long as the word or one letter shorter."""
    both = words.select("word", F.length("word").alias("size"), F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s")))).alias("t")).select("word", "size", "t.back", "t.s")
    # Forwards the edit is at or after the middle, backwards at or after the rest.
    half = F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2)).cast("int")
    entered = both.select("word", "size", "back", "s", F.explode(F.sequence(half, F.col("size") - 1)).alias("at"))
    node, letter, following = _cut("s", F.lit(1), F.col("at")), _cut("s", F.col("at") + 1, F.lit(1)), _cut("s", F.col("at") + 2, F.lit(1))
    states = entered.select("word", "size", "back", "s", "at", node.alias("node"), letter.alias("letter"), following.alias("following"))
    edges = states.select("size", "back", "node", F.col("letter").alias("child"), "following").distinct()
    replaced = _merged(states, edges, ["size", "back", "node", "following"]).where("child <> letter")
    replaced = replaced.select("word", "back", "size", F.concat("node", "child", _cut("s", F.col("at") + 2, F.col("size"))).alias("reached"), (F.col("at") + 2).alias("at"))
    # A deletion in a run of equal letters is taken at the run's first one only, or at the state's entry.
    first = (F.col("at") == half) | (_cut("s", F.col("at"), F.lit(1)) != F.col("letter"))
    deleted = states.where(first).select("word", "back", (F.col("size") - 1).alias("size"), F.concat("node", _cut("s", F.col("at") + 2, F.col("size"))).alias("reached"), (F.col("at") + 1).alias("at"))
    spent = replaced.unionByName(deleted)
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    deep = both.select("back", "size", F.explode(F.sequence(F.floor(F.col("size") / 2).cast("int"), F.col("size"))).alias("d"), "s").select("back", "size", _cut("s", F.lit(1), F.col("d")).alias("node")).distinct()
    step, at = 1, 0
    while True:
        depth = F.least(F.col("at") + at, F.col("size"))
        spent = _merged(spent.withColumn("node", _cut("reached", F.lit(1), depth)), deep, ["back", "size", "node"], "left_semi")
        if at > longest // 2 + 1:
            break
        at, step = at + step, 2 * step
    return spent.select("word", F.when(F.col("back"), F.reverse("reached")).otherwise(F.col("reached")).alias("near")).distinct()


def _gapped(words: DataFrame) -> DataFrame:
    """(word, key, gap): for each letter of a long word two keys, of the word without it (gap false) and with the place open (gap true); and the word's own key as one without."""
    base, prime = 1_000_003, (1 << 61) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word in b.column(0).to_pylist():
                codes, n = [ord(c) for c in word], len(word)
                head, tail, power = [0], [0], [1]
                for c in codes:
                    head.append((head[-1] * base + c) % prime)
                    power.append(power[-1] * base % prime)
                for i, c in enumerate(reversed(codes)):
                    tail.append((c * power[i] + tail[-1]) % prime)
                less = [(head[i] * power[n - 1 - i] + tail[n - 1 - i]) % prime for i in range(n)]
                open_ = [(head[i] * power[n - i] + tail[n - 1 - i] + i * 31) % prime for i in range(n)]
                key = np.array([head[n], *less, *open_], dtype=np.int64)
                kind = np.array([0] + [1] * n + [2] * n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([word] * len(key)), pa.array(key), pa.array(kind), pa.array(np.array([n] + [n - 1] * n + [n] * n, dtype=np.int32))], names=["word", "key", "kind", "size"])

    return words.select("word").mapInArrow(run, "word string, key bigint, kind int, size int")


def _of_long_words(words: DataFrame) -> DataFrame:
    """(word, near) of long words, each pair once, by gapped hashes; then compared letter by letter."""
    keys = _gapped(words)
    whole, less, open_ = (keys.where(F.col("kind") == k).select("word", "key", "size").distinct() for k in range(3))
    near = lambda df: df.select(F.col("word").alias("near"), "key", "size")
    pairs = _merged(less, near(whole), ["key", "size"]).select("word", "near").union(_merged(open_, near(open_), ["key", "size"]).where("word <> near").select("word", "near")).distinct()
    return pairs.where(F.levenshtein("word", "near", 1) == 1)


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, near), both ways, of words that differ by one letter put in, left out or replaced."""
    ship_package(words.sparkSession)
    levels = _by_levels(words.where(F.length("word") <= long))
    pairs = levels.unionByName(_of_long_words(words.where(F.length("word") >= long)))
    return pairs.union(pairs.select("near", "word")).distinct()


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Forms and roots of (word, n): adds form, root, n_near, form_n, as :func:`group_variants` says."""
    words = words.select("word", "n")
    near = _merged(near_words(words), words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = _merged(words, best, "word", "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "forms")
    # Each form has ratio times the words' count, so paths are short; their lengths double in each round.
    links = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(_merged(links, onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_scratch(links)
        links = moved
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    return _merged(found, links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each frequent word of all texts.

    ``form`` is the near word of largest count (ties: the smallest in code-point order) if it has at
    least five times the word's; ``root`` follows forms to the last. Null texts have no words, a
    null id counts as an empty one, repeated rows count each; other columns of ``docs`` don't matter.
    """
    words = materialize(word_counts(docs), "words")
    return variant_forms(words)
