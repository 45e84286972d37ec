"""Bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A document's sketch is the ``k`` smallest distinct 64-bit hashes of its five-word shingles (fewer
words: the whole sequence is one shingle; none: an empty sketch). Sketches of parts merge into the
sketch of the union, and two sketches estimate resemblance, containment and the number of distinct
shingles. A sketch shorter than ``k`` is the whole shingle set, and then the estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.llm.names import fresh

K = 128
SHINGLE_WORDS = 5
_SPACE = " \t\n\x0b\f\r"


def with_word_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the 64-bit hashes of a text's words ``[^\\x20\\x09-\\x0D]+`` in order."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    return df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))


def sketch_of(hashes: str, k: int = K, words: int = SHINGLE_WORDS) -> Column:
    """The bottom-k sketch from a column of word hashes; it must be a plain column, not an expression."""
    h, n = F.col(hashes), F.size(hashes)
    grams = F.transform(F.slice(h, 1, F.greatest(n - (words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(h[i + j] for j in range(1, words))))
    # The hash of an array chains its elements as the hash of several columns does.
    short = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    every = F.when(n >= words, grams).otherwise(short)
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Add the sketch of one text column; null counts as empty."""
    (hashes,) = fresh(df, "hashes")
    return with_word_hashes(df, text, hashes).withColumn(out, sketch_of(hashes, k)).drop(hashes)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance of two sketches; two empty ones resemble fully."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(low, a), b))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the kth hash's share of the range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 where a is empty."""
    union = distinct_count(F.slice(F.sort_array(F.array_union(a, b)), 1, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of each group's union: distinct hashes, the k smallest of each group, gathered.

    The rank is limited before the shuffle, so a hot group sends k rows for each task at most.
    """
    h, r = fresh(df, "h", "r")
    rows = df.select(*keys, F.explode(sketch).alias(h)).distinct()
    low = rows.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(h))).where(F.col(r) <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list(h)).alias(sketch))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _range_bucket(column: Column, cuts: list[int]) -> Column:
    """How many of 2^m - 1 ascending cuts are at or below the value, by binary search; null: 0."""
    table = F.array(*(F.lit(c).cast("bigint") for c in cuts))
    steps, step = [], (len(cuts) + 1) // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    at = F.aggregate(F.array(*steps), F.lit(0), lambda lo, s: F.when(F.element_at(table, lo + s) <= column, lo + s).otherwise(lo))
    return F.when(column.isNull(), F.lit(0)).otherwise(at)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text and of its successor, and their likeness.

    The edited text has its last floor(n/4) code points replaced by the first as many of the next
    document in ascending id (nulls first, rows of one id by text; after the last comes the first).
    Null texts count as empty. Rows are dealt into ranges of ids, cut at approximate quantiles;
    each range also gets the first document of the next, so no task sees the whole order.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = max(1, (parts - 1).bit_length())
    marks = [i / 2**m for i in range(1, 2**m)]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), marks, 20 * 2**m)).first()[0]
    cuts = sorted(cuts) if cuts else [0] * (2**m - 1)
    base = base.withColumn("bucket", _range_bucket(F.col("doc_id"), cuts))
    # One row for each range, 2^m at most.
    firsts = base.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least"), F.bool_or(F.col("doc_id").isNull()).alias("nulls")).collect()
    order = sorted(firsts, key=lambda r: r.bucket)
    rows = base.withColumn("ghost", F.lit(0))
    for nulls in (False, True):
        found = [(r.least, order[i - 1].bucket, int(i == 0)) for i, r in enumerate(order) if r.nulls == nulls]
        if not found:
            continue
        if nulls:
            ghosts = base.where(F.col("doc_id").isNull()).orderBy("text").limit(1).withColumn("bucket", F.lit(found[0][1]))
        else:
            to = F.create_map(*(F.lit(x) for least, bucket, _ in found for x in (least, bucket)))
            ghosts = base.where(F.col("doc_id").isin([x[0] for x in found])).withColumn("bucket", to[F.col("doc_id")])
        rows = rows.union(ghosts.withColumn("ghost", F.lit(1)))
    w = Window.partitionBy("bucket").orderBy("ghost", F.asc_nulls_first("doc_id"), "text")
    n = F.length("text")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("n_chars", n.cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))))
    rows = with_word_hashes(with_word_hashes(rows, "text", "h"), "edited", "eh")
    rows = rows.select("bucket", "ghost", "doc_id", "text", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), sketch_of("h", k).alias("s"), sketch_of("eh", k).alias("es"))
    rows = rows.withColumn("ns", F.lead("s").over(w)).where("ghost = 0")
    return rows.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("es")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("es"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("ns"), k).alias("near_next"),
        distinct_count(F.col("s"), k).alias("distinct_shingles"),
        containment(F.col("s"), F.col("es"), k).alias("contained_in_edited"),
    )
