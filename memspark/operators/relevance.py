"""Rarity of tokens and the gates that decide whether retrieved context is on topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.functions.text import prompt_tokens
from memspark.operators.search import tokens

DISTINCTIVE_IDF, IDF_SUM, MIN_MATCHES, MIN_CORPUS, MAX_TOKENS = 3.0, 7.0, 2, 50, 32


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df): in how many documents each index token occurs."""
    return docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n + 1) / (df + 1)), F.lit(0.0))


def token_idf(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(term, idf, n_docs) of the wanted terms; a term that no document has gets the highest idf."""
    terms = wanted.select("term").distinct()
    n = docs.agg(F.count("*").alias("n_docs"))
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(df, "term", "left").crossJoin(n).select("term", idf(F.col("n_docs"), F.coalesce("df", F.lit(0))).alias("idf"), "n_docs")


def word_runs(c: Column) -> Column:
    """The distinct words of a lower-case text: runs of letters, digits and ``_``."""
    return F.array_distinct(F.split(c, r"[^\p{L}\p{N}_]+"))


def _matches(prompts: DataFrame, items: DataFrame, idfs: DataFrame) -> DataFrame:
    """Of each prompt's first MAX_TOKENS tokens, those that stand in an item's text as whole words, with their idf.

    A token has letters and digits only, so standing between word boundaries is being a whole word
    of the text: an equi-join of tokens and words.
    """
    each = prompts.select("prompt_id", F.explode(F.slice(prompt_tokens(F.col("prompt")), 1, MAX_TOKENS)).alias("term")).join(idfs, "term")
    words = items.select("item_id", F.explode(word_runs(F.col("item_text"))).alias("term")).join(idfs.select("term"), "term", "left_semi")
    return words.join(each, "term")


def _small(sum_col: str = "n_docs") -> Column:
    return F.max(sum_col) < MIN_CORPUS


def lineage_gate(prompts: DataFrame, items: DataFrame, idfs: DataFrame) -> DataFrame:
    """(prompt_id, item_id, n_matched, idf_sum, max_idf, matched, passed) of pairs with a match.

    Passes with at least two matches, an idf sum of 7 and one token of idf 3; in a corpus of fewer
    than 50 documents two matches suffice. ``matched`` maps tokens to idf, for at most MAX_TOKENS.
    ``idfs`` has all tokens of the prompts.
    """
    told = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.round("idf", 9).alias("idf")))))
    pairs = _matches(prompts, items, idfs).groupBy("prompt_id", "item_id").agg(F.count("*").alias("n_matched"), F.round(F.sum("idf"), 9).alias("idf_sum"), F.round(F.max("idf"), 9).alias("max_idf"), _small().alias("small"), told.alias("matched"))
    full = (F.col("idf_sum") >= IDF_SUM) & (F.col("max_idf") >= DISTINCTIVE_IDF)
    return pairs.withColumn("passed", (F.col("n_matched") >= MIN_MATCHES) & (F.col("small") | full)).drop("small")


def _item_passes(matches: DataFrame) -> DataFrame:
    # MAX_TOKENS at most: the distinctive ones, in a small corpus all of them (idf says nothing there).
    told = F.array_sort(F.collect_list(F.when(F.col("idf") >= DISTINCTIVE_IDF, F.struct("term", F.round("idf", 9).alias("idf")))))
    every = F.array_sort(F.collect_list(F.struct("term", F.lit(0.0).alias("idf"))))
    pairs = matches.groupBy("prompt_id", "item_id").agg(F.count("*").alias("n_matched"), F.count_if(F.col("idf") >= DISTINCTIVE_IDF).alias("n_distinctive"), _small().alias("small"), told.alias("told"), every.alias("every"))
    pairs = pairs.withColumn("matched", F.map_from_entries(F.when(F.col("small"), F.col("every")).otherwise(F.col("told")))).drop("told", "every")
    enough = F.when(F.col("small"), F.col("n_matched")).otherwise(F.col("n_distinctive"))
    return pairs.withColumn("passed", enough >= MIN_MATCHES).drop("small")


def item_gate(prompts: DataFrame, items: DataFrame, idfs: DataFrame) -> DataFrame:
    """(prompt_id, item_id, n_matched, n_distinctive, matched, passed): at least two distinctive tokens match."""
    return _item_passes(_matches(prompts, items, idfs))


def item_pairs(prompts: DataFrame, pairs: DataFrame, items: DataFrame, idfs: DataFrame) -> DataFrame:
    """The item gate for given pairs (prompt_id, id) only."""
    each = prompts.select("prompt_id", F.explode(F.slice(prompt_tokens(F.col("prompt")), 1, MAX_TOKENS)).alias("term")).join(idfs, "term")
    words = items.select("item_id", F.explode(word_runs(F.col("item_text"))).alias("term"))
    return _item_passes(pairs.select("prompt_id", F.col("id").alias("item_id")).join(each, "prompt_id").join(words, ["item_id", "term"]))


def thread_hits(gated: DataFrame, most: int = 2) -> DataFrame:
    """The best ``most`` passing items of each prompt by idf sum, then matches, then id."""
    order = Window.partitionBy("prompt_id").orderBy(F.desc("idf_sum"), F.desc("n_matched"), "item_id")
    return gated.where("passed").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def item_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))
