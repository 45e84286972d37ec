"""The kept index: searches equal the exhaustive ranking, updates equal a rebuild, frequent words are mostly not scored."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from memspark.operators import index, relevance, search

SCHEMA = "id bigint, title string, content string"


def corpus(n: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rnd.choices(words, weights, k=2)), " ".join(rnd.choices(words, weights, k=rnd.randrange(5, 80)))) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "", "use_apollo w1 w2, w3"), (n + 2, "use", "apollo use apollo-w1")]


QUERIES = [(0, "w0 w1 w2 w250"), (1, "w0 w0 w299, w280!"), (2, "use_apollo w0"), (3, "nothing here"), (4, "w1-w0 w5"), (5, "w3"), (6, " ".join(f"w{i}" for i in range(40)))]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def ranked(frame, id_col="id"):
    return sorted((r.query_id, r.rank, r[id_col], round(r.score, 7)) for r in frame.collect())


@pytest.mark.parametrize(("n", "k"), [(0, 3), (60, 5), (1_500, 10)])
def test_search_equals_the_exhaustive_ranking(spark, asked, n, k):
    docs = spark.createDataFrame(corpus(n, 7), SCHEMA).repartition(3)
    for cols in (("content",), ("title", "content")):
        made = index.build(docs, text_cols=cols)
        assert ranked(index.search(made, asked, k)[0]) == ranked(search.bm25(docs, asked, k, text_cols=cols))
        want = {r.term: r.df for r in relevance.document_frequency(docs, "id", "content").collect()}
        if cols == ("content",):
            assert {r.term: r.df for r in index.document_frequency(made).collect()} == want


def test_frequent_words_are_mostly_not_scored(spark):
    docs = spark.createDataFrame(corpus(4_000, 3), SCHEMA).repartition(6)
    query = spark.createDataFrame([(0, "w0 w1 w2 w3 w290 w280")], "query_id int, query string")
    got, report = index.search(index.build(docs), query, 5)
    assert ranked(got) == ranked(search.bm25(docs, query, 5))
    r = report.first()
    assert r.scored < r.postings / 3


def test_updates_equal_a_rebuild(spark, asked):
    old = spark.createDataFrame(corpus(900, 1), SCHEMA)
    fresh = spark.createDataFrame([(r[0], r[1], r[2]) for r in corpus(200, 2)] + [(5_000, "w1", "w1 w299 use_apollo")], SCHEMA)
    made = index.build(old, text_cols=("title", "content"))
    removed = old.where("id < 250 or id % 7 = 0")
    second = index.update(made, removed, fresh.where("id < 150 or id > 1000"), text_cols=("title", "content"))
    third = index.update(second, fresh.where("id < 50"), fresh.where("id < 10"), text_cols=("title", "content"))
    now = old.join(removed.select("id"), "id", "left_anti").select("id", "title", "content").unionByName(fresh.where("(id >= 50 and id < 150) or id > 1000 or id < 10"))
    rebuilt = index.build(now, text_cols=("title", "content"))
    want = ranked(index.search(rebuilt, asked, 8)[0])
    assert ranked(index.search(third, asked, 8)[0]) == want == ranked(search.bm25(now, asked, 8, text_cols=("title", "content")))
    assert ranked(index.search(index.merge(third), asked, 8)[0]) == want
    for i in (third, index.merge(third)):
        assert sorted(map(tuple, index.document_frequency(i).collect())) == sorted(map(tuple, index.document_frequency(rebuilt).collect()))
    # Generations before stay as they were.
    assert ranked(index.search(made, asked, 8)[0]) == ranked(search.bm25(old, asked, 8, text_cols=("title", "content")))


def test_a_search_reads_its_terms_folders(spark):
    made = index.build(spark.createDataFrame(corpus(50, 1), SCHEMA))
    terms = spark.createDataFrame([("w1",)], "term string")
    plan = index._of_terms(made, "postings", terms)._jdf.queryExecution().executedPlan().toString()
    own = terms.select(index.bucket(F.col("term"))).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*\(bucket#\d+ = {own}\)", plan), plan


def test_rarity_comes_from_the_dictionary(spark):
    docs = spark.createDataFrame(corpus(300, 9), SCHEMA)
    wanted = spark.createDataFrame([("w0",), ("w299",), ("absent",)], "term string")
    got = {r.term: (round(r.idf, 9), r.n_docs) for r in index.token_idf(index.build(docs), wanted).collect()}
    assert got == {r.term: (round(r.idf, 9), r.n_docs) for r in relevance.token_idf(docs, wanted, "content").collect()}
