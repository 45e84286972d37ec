"""What searches of many long queries write and shuffle: in the order of their texts, not of (query, text) pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from memspark.jobs import catalog
from memspark.operators import scoring, search


def written(spark, make) -> int:
    """How many rows stages wrote and shuffled while ``make`` ran."""
    jvm = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def stages() -> dict:
        listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        each = [listed.apply(i) for i in range(listed.size())]
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in each}

    before = stages()
    make()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(v for k, v in stages().items() if k not in before)


def texts(n: int) -> list[tuple]:
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(rnd.choices(words, [1 / (i + 5) for i in range(400)], k=60))) for i in range(n)]


def test_long_queries_write_no_row_for_each_pair(spark):
    docs = spark.createDataFrame(texts(2_000), "id bigint, content string").cache()
    queries = docs.where("id % 40 = 0").selectExpr("id AS query_id", "content AS query")
    docs.count()
    rows = written(spark, lambda: search.bm25(docs, queries, 5).collect())
    assert rows < 15 * 2_000  # 50 queries: 100,000 pairs, 80,000 postings


def test_search_of_projects_writes_no_row_for_each_pair(spark):
    rows = [(i, t, f"p{i % 3}", 5) for i, t in texts(2_000)]
    docs = spark.createDataFrame([*rows, *((i, "mirrored", "a", 5) for i, *_ in rows[::3])], "id bigint, content string, origin_project string, signal_weight int").cache()
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(2_000)], "chunk_id bigint, embedding array<float>")
    queries = docs.where("id % 40 = 1 and origin_project <> 'a'").select(F.col("id").alias("query_id"), F.col("content").alias("query"), F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("vector"))
    docs.count()
    got = []
    n = written(spark, lambda: got.extend(search.cross_project(docs, vectors, queries, 3).collect()))
    assert len(got) == 150 and all(r.origin_project == ("a" if r.id % 3 == 0 else f"p{r.id % 3}") for r in got)
    assert n < 25 * 2_000


@pytest.mark.parametrize("n", [7, 300])
def test_blocks_give_what_one_block_gives(spark, monkeypatch, n):
    docs = spark.createDataFrame([*texts(n), *((n + i, t) for i, t in texts(n)), (9_000, None), (9_001, ""), (9_002, "use_apollo w1")], "id bigint, content string")
    queries = spark.createDataFrame([(0, "w0 w1 w2 w0"), (1, "w399 use_apollo w5"), (2, "none"), *((3 + i, t) for i, t in texts(6))], "query_id int, query string")
    ranked = lambda: sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in search.bm25(docs, queries, 10).collect())
    whole = ranked()
    for name, value in (("WORDS", 2_000), ("ASKED", 40), ("CELLS", 100), ("ADDED", 50), ("FREQUENT", 3)):
        monkeypatch.setattr(scoring, name, value)
    assert ranked() == whole and len(whole) > 20


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, f"s{i % 4}", len(t)) for i, t in texts(2_000)], "doc_id bigint, text string, source string, n_chars bigint")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 40), float(i // 40)]) for i in range(2_000)], "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, i % 3 % 2, i % 5 % 2) for i in range(0, 2_000, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["d5_rrf", "d6_boost", "d7_hybrid", "d9_text_leg_only"])
def test_queries_write_no_row_for_each_pair(spark, folder, name):
    got = []
    n = written(spark, lambda: got.extend(catalog.QUERIES[name](spark, folder).collect()))
    assert got and n < 30 * 2_000
