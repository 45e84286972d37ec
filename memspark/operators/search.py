"""Ranked retrieval: BM25 with phrases, vector neighbours, reciprocal-rank fusion, filters and boosts.

Everything is batched over a frame of queries. Query terms are written to a small table first, so
that Spark knows its size and broadcasts it only below its threshold. A corpus is read twice: for its words'
frequencies and lengths, and to be scored in blocks (:mod:`scoring`); no posting is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.operators import near, scoring
from memspark.operators.scoring import B, K1  # noqa: F401  for the index
from memspark.session import materialize

RRF = 60
MAX_TERMS, MAX_TERM_CHARS = 256, 64
_NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}\p{M}]+"
_ENDS = ".,!?;:()[]{}<>"


def tokens(c: Column) -> Column:
    """Lower-case index tokens of a text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _NOT_TOKEN), lambda t: t != "")


def query_terms(c: Column, most: int = MAX_TERMS, longest: int = MAX_TERM_CHARS) -> Column:
    """Words of a query with the punctuation at their ends gone.

    Up to ``most`` words stay as they are, repeats too; of more, long ones go, repeats go, and the
    first ``most`` stay.
    """
    words = F.filter(F.transform(F.split(c, r"\s+"), lambda t: F.btrim(t, F.lit(_ENDS))), lambda t: t != "")
    few = F.slice(F.array_distinct(F.filter(words, lambda t: F.length(t) <= longest)), 1, most)
    return F.when(F.size(words) > most, few).otherwise(words)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_cols: tuple[str, ...] = ("content",)) -> DataFrame:
    """(query_id, id_col, score, rank) of the k best documents of each query (query_id, query).

    A query is the OR of its words; a word with inner punctuation is a phrase of its tokens. Word
    frequencies and lengths count over all text columns; phrases don't span columns. A negative
    idf counts as 1e-6; a word that a query repeats counts again. Ties go to the smaller id.
    """
    asked = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("word")).select("query_id", tokens(F.col("word")).alias("p")).where(F.size("p") > 0)
    asked = materialize(asked.groupBy("query_id", "p").agg(F.count("*").alias("times"), F.size("p").alias("m")).withColumn("term", F.array_join("p", _AFTER)), "asked")
    texts = _texts(docs, asked.where("m > 1").select("p", "m", "term").distinct(), id_col, text_cols)
    wanted = asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    # Texts have no empty word: the empty one stands for the text itself.
    each = texts.select("len", F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("len"))).alias("total"))
    counts = materialize(counts.join(wanted, "term"), "frequencies")
    n_docs, total = counts.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * F.when(idf <= 0, 1e-6).otherwise(idf)
    own = asked.join(counts, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("x"))
    own = materialize(own.select("query_id", F.col("x.term").alias("words"), F.col("x.weight").alias("weights")), "weighted")
    found = scoring.best(texts.select("id", "len", F.array_join("t", " ").alias("text")), own, k, n_docs or 1, total)
    return top_k(found, k).withColumnRenamed("id", id_col)


#: Stands between the words of a phrase; no word has it.
_AFTER = "\x1f"


def _placed(tokens_col: Column, i: int) -> Column:
    return F.transform(tokens_col, lambda t, pos: F.struct(F.lit(i).alias("col"), pos.alias("pos"), t.alias("term")))


def _texts(docs: DataFrame, phrases: DataFrame, id_col: str, text_cols: tuple[str, ...]) -> DataFrame:
    """(id, len, t): the words of documents and, after them, the phrases (p, m, term) that stand in them, as often as they do."""
    own = docs.select(F.col(id_col).alias("id"), *(tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(text_cols)))
    own = own.withColumn("t", F.concat(*(f"t{i}" for i in range(len(text_cols))))).withColumn("len", F.size("t"))
    if not phrases.limit(1).count():
        return own.select("id", "len", "t")
    terms = materialize(phrases.select("term", "m", F.posexplode("p").alias("at", "word")), "phrases")
    each = own.select("id", F.explode(F.concat(*(_placed(F.col(f"t{i}"), i) for i in range(len(text_cols))))).alias("x")).select("id", "x.col", "x.pos", F.col("x.term").alias("word"))
    starts = each.join(terms, "word").groupBy("id", "col", "term", "m", (F.col("pos") - F.col("at")).alias("start")).count().where("count = m")
    hits = materialize(starts.groupBy("id").agg(F.collect_list("term").alias("phrases")), "hits")
    return own.join(hits, "id", "left").select("id", "len", F.concat("t", F.coalesce("phrases", F.array().cast("array<string>"))).alias("t"))


def top_k(scored: DataFrame, k: int, by: str = "score", descending: bool = True) -> DataFrame:
    """The k first rows of each query with 0-based ranks; the limit is applied before the shuffle."""
    order = F.desc(by) if descending else F.asc(by)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """L2 or cosine distance of two arrays, in double precision."""
    pair = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    if metric == "l2":
        return F.sqrt(F.aggregate(pair, F.lit(0.0), lambda s, p: s + (p["x"] - p["y"]) * (p["x"] - p["y"])))
    dot = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["x"] * p["y"])
    na, nb = (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b))
    return 1 - dot / (na * nb)


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """(query_id, id_col, distance, rank) of the k nearest vectors of each query (query_id, vector).

    L2 distances are exact and pruned by :mod:`near`. By cosine every query meets every vector of
    its length: vectors are dealt into as many segments as a shuffle has partitions, and each
    segment's pairs are cut to k before they are shuffled.
    """
    if metric == "l2":
        found, _ = near.nearest(vectors, queries, k, id_col, vector_col)
        return top_k(found.withColumn("distance", F.round("distance", 9)), k, "distance", descending=False).withColumnRenamed("id", id_col)
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull()).withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    asked = materialize(queries.select("query_id", F.col("vector").alias("q")).where("q is not null"), "query_vectors")
    asked = asked.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = own.join(asked, (own["segment"] == asked["segment"]) & (F.size("q") == F.size("v")))
    scored = met.select("query_id", "id", F.round(distance(F.col("v"), F.col("q"), metric), 9).alias("distance"))
    return top_k(scored, k, "distance", descending=False).withColumnRenamed("id", id_col)


def fuse(text_leg: DataFrame, vector_leg: DataFrame, constant: int = RRF) -> DataFrame:
    """Full outer merge of two ranked legs (query_id, id, rank): sum of 1/(constant + rank + 1)."""
    a = text_leg.select("query_id", "id", F.col("rank").alias("text_rank"))
    b = vector_leg.select("query_id", "id", F.col("rank").alias("vector_rank"))
    share = [F.coalesce(1.0 / (constant + F.col(c) + 1), F.lit(0.0)) for c in ("text_rank", "vector_rank")]
    return a.join(b, ["query_id", "id"], "full_outer").withColumn("fusion_score", F.round(share[0] + share[1], 12))


def boost(rows: DataFrame, weight: str = "signal_weight") -> DataFrame:
    """final_score = fusion_score * (1 + weight/100); a missing or zero weight counts as 10."""
    w = F.coalesce(F.nullif(F.col(weight), F.lit(0)), F.lit(10))
    return rows.withColumn("final_score", F.round(F.col("fusion_score") * (1 + w / 100.0), 12))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, keep: tuple[str, ...] = ("signal_weight",), text_cols: tuple[str, ...] = ("content",), metric: str = "l2", text: DataFrame | None = None) -> DataFrame:
    """Both legs fetch 3k; fuse, then filter, then boost, then cut to k: fewer than k may come back.

    ``queries``: (query_id, query, vector); a null vector (a failed embedding) leaves the text leg.
    ``text``: a text leg (query_id, id, rank) from a kept index, of 3k ranks; else the documents are read.
    """
    return combined(docs, *legs(docs, vectors, queries, k, text_cols, metric, text), k, where, keep)


def legs(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, text_cols: tuple[str, ...] = ("content",), metric: str = "l2", text: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The 3k best of either leg (query_id, id, rank), written once; a search for fewer takes the first ranks of them."""
    text = (bm25(docs, queries, 3 * k, "id", text_cols) if text is None else text).select("query_id", "id", "rank")
    close = knn(vectors, queries, 3 * k, metric=metric).select("query_id", F.col("chunk_id").alias("id"), "rank")
    return materialize(text, "text_leg"), materialize(close, "vector_leg")


def combined(docs: DataFrame, text: DataFrame, near: DataFrame, k: int, where: Column | None = None, keep: tuple[str, ...] = ("signal_weight",)) -> DataFrame:
    """The k best of both legs' first 3k: fused, filtered, boosted."""
    fused = fuse(text.where(F.col("rank") < 3 * k), near.where(F.col("rank") < 3 * k))
    rows = docs.select("id", *keep).join(fused, "id")
    if where is not None:
        rows = rows.where(where)
    return top_k(boost(rows), k, "final_score")


def without_vectors(queries: DataFrame, failed: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """Queries whose embedding failed (query_id, reason) lose their vector, and a degradation row is made of each.

    Such a query is answered by its text leg alone.
    """
    out = queries.join(failed.select("query_id", "reason").dropDuplicates(["query_id"]), "query_id", "left")
    rows = out.where("reason is not null").select(ts.alias("ts"), F.lit("search").alias("component"), F.col("query_id"), F.substring("reason", 1, 500).alias("detail"))
    return out.withColumn("vector", F.when(F.col("reason").isNull(), F.col("vector"))).drop("reason"), rows


def union_of_projects(projects: dict[str, DataFrame]) -> DataFrame:
    """The projects' frames as one, with the project's name in origin_project."""
    named = [d.withColumn("origin_project", F.lit(n)) for n, d in sorted(projects.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def cross_project(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, keep: tuple[str, ...] = ("signal_weight",)) -> DataFrame:
    """The hybrid search over the chunks and vectors of all projects; rows carry origin_project.

    Equal ids are one chunk: that of the first project by name, mirrored once. Contents are dealt by id once and written.
    """
    rest = F.struct(*(c for c in docs.columns if c != "id"))
    first = docs.groupBy("id").agg(F.min_by(rest, "origin_project").alias("x")).where("x is not null")
    own = materialize(first.select("id", "x.*"), "chunks")
    return hybrid(own, vectors.dropDuplicates(["chunk_id"]), queries, k, where, (*keep, "origin_project"))


def result_line(score: Column, source: Column, module: Column, content: Column) -> Column:
    from memspark.functions.text import clip

    return F.format_string("[%.3f] (%s / %s) %s", score, source, F.coalesce(module, F.lit("-")), clip(content, 140))
