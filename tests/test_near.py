"""Exact nearest vectors: as brute force, with far fewer comparisons where vectors have structure."""

from __future__ import annotations

import numpy as np
import pytest

from memspark.operators import near, search

SCHEMA = "chunk_id bigint, embedding array<float>"


def clustered(n: int) -> np.ndarray:
    rng = np.random.default_rng(8)
    return (rng.normal(size=(30, 8)) * 20)[rng.integers(0, 30, n)] + rng.normal(size=(n, 8))


@pytest.mark.parametrize(("n", "k", "block"), [(0, 3, 50), (2, 5, 50), (1_500, 5, 40), (1_500, 1, 20_000)])
def test_nearest_matches_brute_force(spark, n, k, block):
    v = np.round(clustered(n), 3) if n else np.zeros((0, 8))
    if n > 10:
        v[1:4] = v[0]  # ties
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(9_000, None), (9_001, [1.0, 2.0]), (9_002, [None] * 8), (9_003, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    asked = [(i, rows[i * 50][1]) for i in range(n // 50)] + [(700, [0.5] * 8), (701, None), (702, [3.0, 4.0]), (703, [1.0])]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<float>")
    found, _ = near.nearest(vectors, queries, k, block=block)
    got = {(r.query_id, r["rank"]): (r.id, round(r.distance, 6)) for r in search.top_k(found.withColumn("distance", found.distance), k, "distance", descending=False).collect()}
    want = {}
    for q, x in asked:
        if x is not None:
            far = sorted((round(float(np.linalg.norm(np.float32(x).astype(float) - np.float32(y).astype(float))), 12), i) for i, y in rows if y is not None and len(y) == len(x) and None not in y and not np.isnan(y).any())
            want |= {(q, r): (i, round(d, 6)) for r, (d, i) in enumerate(far[:k])}
    assert got == want


def test_few_pairs_are_compared(spark):
    counts = []
    for n in (1_000, 8_000):
        v = clustered(n)
        vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
        queries = vectors.where("chunk_id % 50 = 0").selectExpr("chunk_id AS query_id", "embedding AS vector")
        _, report = near.nearest(vectors, queries, 3)
        counts.append(sum(r.compared for r in report.collect()) / n)
    assert counts[0] < 0.3 * 20
    assert counts[1] < 0.2 * 160
