"""A kept inverted index: postings on disk by term, replaced by document, searched with bounds.

An index is a folder of three tables, each written generation by generation:

* ``postings`` (gen, bucket, term, block, n, max_tf, min_len, ids, tfs, lens, places): for a term and a
  block of documents one row, with arrays of the documents that have it, how often, how long they are
  and where. Rows lie in folders by the hash of their term and sorted by it, so that a search
  reads the folders and row groups of its terms only.
* ``terms`` (gen, bucket, term, df) and ``sizes`` (gen, n_docs, total): what a generation adds to
  document frequencies and to the corpus; an update's removals are negative.
* ``dead`` (gen, id): postings of an id from generations before this one no longer count.

An update writes a new generation and touches none before it; :func:`merge` writes all living
postings as one. Search results are those of a rebuilt index in either case.

Top-k search scores most postings of frequent words never. A term's blocks bound what it can add to a
document's score. The terms that could add most are scored first and give a threshold that the k-th
best will reach; terms whose bounds together stay below it can't bring in a document alone, so their
blocks are read for candidates only, and only for those that could still reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from memspark.operators.search import B, K1, query_terms, tokens, top_k
from memspark.session import materialize, scratch_path, ship_package

BUCKETS = 64
#: Places of the second and further text columns begin here, so that no phrase spans columns.
COLUMN = 1 << 40
_BLOCKS = "term string, block bigint, n int, max_tf int, min_len bigint, ids array<bigint>, tfs array<int>, lens array<bigint>, places array<array<bigint>>"
_POSTINGS = f"gen int, bucket int, {_BLOCKS}"
_SIZES = "gen int, n_docs bigint, total bigint"


@dataclass(frozen=True)
class Index:
    """An index folder, up to one generation."""

    spark: SparkSession
    root: str
    gen: int

    def read(self, name: str) -> DataFrame:
        schema = {"postings": _POSTINGS, "terms": "gen int, bucket int, term string, df bigint", "sizes": _SIZES, "dead": "gen int, id bigint"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("gen") <= self.gen)


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _inverted(docs: DataFrame, id_col: str, text_cols: tuple[str, ...], gen: int) -> DataFrame:
    """One row for each term and batch of documents; a batch is inverted where it is read."""
    ship_package(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), *(tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(text_cols)))
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int64()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int64())), ("places", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = gen << 52 | TaskContext.get().partitionId() << 24
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                lists = [part.column(i + 1) for i in range(len(text_cols))]
                size = np.array([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists])
                words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                doc = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in size])
                place = np.concatenate([np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + i * COLUMN for i, n in enumerate(size)])
                code = words.indices.to_numpy(zero_copy_only=False)
                if not len(code):
                    continue
                order = np.lexsort((place, doc, code))
                code, doc, place = code[order], doc[order], place[order]
                post = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))  # a posting's first place
                tf = np.diff(np.append(post, len(code))).astype(np.int32)
                head = np.flatnonzero(np.append(True, np.diff(code[post]) != 0))  # a term's first posting
                n = np.diff(np.append(head, len(post))).astype(np.int32)
                lens = size.sum(axis=0).astype(np.int64)[doc[post]]
                cuts = np.append(head, len(post)).astype(np.int32)
                arrays = [
                    words.dictionary.take(pa.array(code[post][head])), pa.array(np.full(len(head), block)), pa.array(n), pa.array(np.maximum.reduceat(tf, head)), pa.array(np.minimum.reduceat(lens, head)),
                    pa.ListArray.from_arrays(cuts, part.column(0).take(pa.array(doc[post]))), pa.ListArray.from_arrays(cuts, pa.array(tf)), pa.ListArray.from_arrays(cuts, pa.array(lens)),
                    pa.ListArray.from_arrays(cuts, pa.ListArray.from_arrays(np.append(post, len(code)).astype(np.int32), pa.array(place.astype(np.int64)))),
                ]
                block += 1
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return own.mapInArrow(run, _BLOCKS)


def _sizes(docs: DataFrame, text_cols: tuple[str, ...], sign: int) -> DataFrame:
    n = sum((F.size(tokens(F.col(c))) for c in text_cols[1:]), F.size(tokens(F.col(text_cols[0]))))
    return docs.agg((F.count("*") * sign).alias("n_docs"), (F.coalesce(F.sum(n), F.lit(0)) * sign).cast("bigint").alias("total"))


def _write(rows: DataFrame, root: str, name: str, gen: int, by: tuple[str, ...] = ()) -> None:
    rows.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("gen", *by).parquet(f"{root}/{name}")


def _write_postings(blocks: DataFrame, root: str, gen: int) -> None:
    """Blocks of a generation by bucket of their terms, and their document frequencies."""
    placed = blocks.withColumn("bucket", bucket(F.col("term"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "block")
    _write(placed, root, "postings", gen, ("bucket",))


def _write_terms(terms: DataFrame, root: str, gen: int) -> None:
    rows = terms.groupBy("term").agg(F.sum("df").cast("bigint").alias("df")).where("df <> 0").withColumn("bucket", bucket(F.col("term")))
    _write(rows.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term"), root, "terms", gen, ("bucket",))


def build(docs: DataFrame, root: str | None = None, id_col: str = "id", text_cols: tuple[str, ...] = ("content",)) -> Index:
    """Index all documents (ids are integers; null texts are empty) below ``root``, or in scratch space."""
    spark = docs.sparkSession
    root = root or scratch_path(spark, "index")
    _write_postings(_inverted(docs, id_col, text_cols, 0), root, 0)
    made = spark.read.schema(_POSTINGS).parquet(f"{root}/postings")
    _write_terms(made.select("term", F.col("n").alias("df")), root, 0)
    _write(_sizes(docs, text_cols, 1), root, "sizes", 0)
    _write(docs.select(F.col(id_col).cast("bigint").alias("id")).where(F.lit(False)), root, "dead", 0)
    return Index(spark, root, 0)


def update(index: Index, removed: DataFrame, fresh: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("content",)) -> Index:
    """The next generation: without the documents ``removed`` (as they were indexed), with those of ``fresh``.

    Files that were read again are replaced so: their stored chunks are removed, their new ones come.
    """
    gen, root = index.gen + 1, index.root
    blocks = materialize(_inverted(fresh, id_col, text_cols, gen), "blocks")
    _write_postings(blocks, root, gen)
    gone = removed.select(F.explode(F.array_distinct(F.concat(*(tokens(F.col(c)) for c in text_cols)))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
    _write_terms(blocks.select("term", F.col("n").cast("bigint").alias("df")).unionByName(gone), root, gen)
    _write(_sizes(fresh, text_cols, 1).unionByName(_sizes(removed, text_cols, -1)), root, "sizes", gen)
    _write(removed.select(F.col(id_col).cast("bigint").alias("id")).distinct(), root, "dead", gen)
    return Index(index.spark, root, gen)


def merge(index: Index, root: str | None = None) -> Index:
    """All living postings as one generation in a new folder."""
    root = root or scratch_path(index.spark, "index")
    each = index.read("postings").select("gen", "term", "block", F.explode(F.arrays_zip("ids", "tfs", "lens", "places")).alias("x")).select("gen", "term", "block", F.col("x.ids").alias("id"), "x.tfs", "x.lens", "x.places")
    told = F.array_sort(F.collect_list(F.struct("id", "tfs", "lens", "places")))
    rows = _living(index, each).groupBy("term", "block").agg(told.alias("x"))
    rows = rows.select("term", "block", F.size("x").alias("n"), F.array_max("x.tfs").alias("max_tf"), F.array_min("x.lens").alias("min_len"), F.col("x.id").alias("ids"), F.col("x.tfs").alias("tfs"), F.col("x.lens").alias("lens"), F.col("x.places").alias("places"))
    _write_postings(rows, root, 0)
    _write_terms(index.read("terms").select("term", "df"), root, 0)
    _write(index.read("sizes").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total")), root, "sizes", 0)
    _write(index.read("dead").select("id").where(F.lit(False)), root, "dead", 0)
    return Index(index.spark, root, 0)


def document_frequency(index: Index) -> DataFrame:
    """(term, df) of every living term."""
    return index.read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def token_idf(index: Index, wanted: DataFrame) -> DataFrame:
    """(term, idf, n_docs) of the wanted terms, from the dictionary alone."""
    from memspark.operators.relevance import idf

    terms = wanted.select("term").distinct()
    df = _of_terms(index, "terms", terms).groupBy("term").agg(F.sum("df").alias("df"))
    n = index.read("sizes").agg(F.sum("n_docs").alias("n_docs"))
    return terms.join(df, "term", "left").crossJoin(n).select("term", idf(F.col("n_docs"), F.coalesce("df", F.lit(0))).alias("idf"), "n_docs")


def _of_terms(index: Index, name: str, terms: DataFrame) -> DataFrame:
    """Rows of the given terms; only their buckets' folders are read (numbers below BUCKETS reach the driver)."""
    asked = terms.select("term", bucket(F.col("term")).alias("bucket"))
    folders = [r[0] for r in asked.select("bucket").distinct().collect()]
    return index.read(name).where(F.col("bucket").isin(folders)).join(asked, ["bucket", "term"])


def _living(index: Index, rows: DataFrame) -> DataFrame:
    """Rows (gen, id, ...) that no later generation removed."""
    dead = index.read("dead").groupBy("id").agg(F.max("gen").alias("_dead"))
    return rows.join(dead, "id", "left").where("_dead is null or gen >= _dead").drop("_dead")


def _part(tf: Column, n: Column, mean: Column) -> Column:
    """What a word that stands ``tf`` times in a text of ``n`` words adds, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _each(blocks: DataFrame) -> DataFrame:
    """Postings of blocks (query_id, p, weight, avg_len, ...): (query_id, p, id, gen, part of the score)."""
    x = blocks.withColumn("x", F.explode(F.arrays_zip("ids", "tfs", "lens")))
    return x.select("query_id", "p", "block", F.col("x.ids").alias("id"), "gen", (F.col("weight") * _part(F.col("x.tfs"), F.col("x.lens"), F.col("avg_len"))).alias("s"))


def _phrases(index: Index, phrases: DataFrame) -> DataFrame:
    """Blocks of phrases (p: several tokens), each found where its tokens stand one after the other."""
    terms = phrases.select("p", F.posexplode("p").alias("at", "term"))
    blocks = _of_terms(index, "postings", terms.select("term").distinct()).join(terms, "term")
    x = blocks.select("p", "at", "block", "gen", F.explode(F.arrays_zip("ids", "lens", "places")).alias("x"))
    x = x.select("p", "at", "gen", "block", F.col("x.ids").alias("id"), F.col("x.lens").alias("len"), F.explode("x.places").alias("place")).withColumn("start", F.col("place") - F.col("at"))
    hits = x.groupBy("p", "gen", "block", "id", "len", "start").count().where("count = size(p)").groupBy("p", "gen", "block", "id", "len").agg(F.count("*").cast("int").alias("tf"))
    hits = _living(index, hits)
    return hits.groupBy("p", "gen", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list("id").alias("ids"), F.collect_list("tf").alias("tfs"), F.collect_list("len").alias("lens"))


def search(index: Index, queries: DataFrame, k: int, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), report) of the k best documents of each query (query_id, query), as ``search.bm25`` ranks them.

    The report (query_id, postings, scored) says how many postings a query's words have, and how
    many of them were scored. Scores are rounded to ``digits``, and equal ones go to the smaller id.
    """
    each = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("word"))
    asked = materialize(each.groupBy("query_id", "word").agg(F.count("*").alias("times")).withColumn("p", tokens(F.col("word"))).where(F.size("p") > 0).groupBy("query_id", "p").agg(F.sum("times").alias("times")), "asked")
    corpus = index.read("sizes").agg(F.sum("n_docs").alias("n_docs"), (F.sum("total") / F.sum("n_docs")).alias("avg_len"))
    single = asked.where("size(p) = 1").select("p", F.col("p")[0].alias("term")).distinct()
    columns = ("p", "gen", "block", "n", "max_tf", "min_len", "ids", "tfs", "lens")
    blocks = _of_terms(index, "postings", single.select("term")).withColumn("p", F.array("term")).select(*columns)
    df = _of_terms(index, "terms", single.select("term")).groupBy(F.array("term").alias("p")).agg(F.sum("df").alias("df"))
    if asked.where("size(p) > 1").limit(1).count():
        found = materialize(_phrases(index, asked.where("size(p) > 1").select("p").distinct()), "phrases")
        blocks = blocks.unionByName(found.select(*columns))
        df = df.unionByName(found.groupBy("p").agg(F.sum("n").cast("bigint").alias("df")))
    blocks = materialize(blocks, "blocks")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    best = blocks.crossJoin(corpus).groupBy("p").agg(F.max(_part(F.col("max_tf"), F.col("min_len"), F.col("avg_len"))).alias("most"), F.first("avg_len").alias("avg_len"), F.first("n_docs").alias("n_docs"))
    words = asked.join(best.join(df, "p"), "p").select("query_id", "p", "df", "avg_len", (F.col("times") * F.when(idf <= 0, 1e-6).otherwise(idf)).alias("weight"), "most")
    words = words.withColumn("bound", F.col("weight") * F.col("most"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "p")
    # A first threshold from the words that could add most, until they have ten times k postings.
    words = materialize(words.withColumn("before", F.coalesce(F.sum("df").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "words")
    meet = blocks.drop("n", "max_tf", "min_len")
    first = materialize(_living(index, _each(meet.join(words.where(F.col("before") < 10 * k).drop("most"), "p"))), "first")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))

    def threshold(sums: DataFrame) -> DataFrame:
        """(query_id, floor): the k-th best of sums, a little less for rounding; queries with fewer have none."""
        return sums.withColumn("_n", nth).where(F.col("_n") == k).select("query_id", (F.col("s") - 2 * 10.0**-digits).alias("floor"))

    floor = threshold(first.groupBy("query_id", "id").agg(F.sum("s").alias("s")))
    below = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "p"))  # what the word and all lesser ones can add
    words = materialize(words.withColumn("below", below).join(floor, "query_id", "left").withColumn("leads", F.coalesce(F.col("below") >= F.col("floor"), F.lit(True))), "leads")
    led = materialize(_living(index, _each(meet.join(words.where("leads").drop("most"), "p"))), "led")
    sums = led.groupBy("query_id", "id", "block").agg(F.sum("s").alias("s"))
    rest = words.groupBy("query_id").agg(F.sum(F.when(~F.col("leads"), F.col("bound"))).alias("rest"))
    still = sums.join(rest, "query_id").join(threshold(sums), "query_id", "left").where(F.col("floor").isNull() | (F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")))
    still = materialize(still.select("query_id", "id", "block"), "candidates")
    # Lesser words are scored for candidates only: a block (of so many documents at most) is opened if it holds one.
    ids = still.groupBy("query_id", "block").agg(F.collect_set("id").alias("_ids"))
    opened = meet.join(ids.join(words.where("not leads").select("query_id", "p", "weight", "avg_len"), "query_id"), ["p", "block"])
    x = opened.withColumn("x", F.explode(F.filter(F.arrays_zip("ids", "tfs", "lens"), lambda x: F.array_contains("_ids", x["ids"]))))
    added = materialize(_living(index, x.select("query_id", "p", "block", F.col("x.ids").alias("id"), "gen", (F.col("weight") * _part(F.col("x.tfs"), F.col("x.lens"), F.col("avg_len"))).alias("s"))), "added")
    scored = led.join(still, ["query_id", "id"], "left_semi").unionByName(added).groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score"))
    counts = first.unionByName(led).unionByName(added).groupBy("query_id").agg(F.count("*").alias("scored"))
    report = words.groupBy("query_id").agg(F.sum("df").alias("postings")).join(counts, "query_id", "left")
    return top_k(scored, k), report
