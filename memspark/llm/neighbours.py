"""Approximate nearest neighbours by an adaptive dimension scan.

Unit vectors are turned by a random rotation and kept in column blocks. Lists around centroids
(fitted on a sample of ``SAMPLE`` rows at most) hold every vector; a query probes the lists with
the nearest centroids. Within a list the scan adds up squared distances block by block. After d of
D rotated dimensions the distance so far, times D/d, estimates the whole one, and a candidate is
abandoned as soon as the estimate exceeds the query's bound by more than a factor of
1 + EPSILON/sqrt(d): the hypothesis that it still belongs among the nearest is rejected. Survivors
are compared by exact cosines of the original vectors.

Lists grow in number with the rows, so that their length stays the same up to SAMPLE / 8 lists.
Vectors that many rows share enter once, with as many of their smallest ids as a result can show.
Long lists are split into segments and the queries of a list into blocks, which meet each other, so
no group is unbounded. A query meets its segments in rounds, the nearest ``FIRST`` first and then up
to ``WIDER`` times as many as it has met, and brings along the bound of what it has found: a round's
pairs are those that still improve on it, so they don't grow with the number of segments. A query
that finds fewer vectors than asked for probes all lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.session import materialize, ship_package

SAMPLE = 20_000
#: Rows for each list, while the sample admits so many lists.
LIST_ROWS = 200
#: A query probes as many lists as hold this share of the sample's own nearest neighbours.
HELD, MIN_PROBED = 0.98, 8
SEGMENT, QUERIES = 20_000, 2_000
#: Segments of a query's first round, and by how much each round at most widens what was met.
FIRST, WIDER = 8, 8
BLOCK = 16
EPSILON = 2.1
#: Of the pairs of a tile, the share alive below which the scan goes on pair by pair.
SPARSE = 0.1
SEED = 42


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def valid(vector: Column) -> Column:
    """Neither null nor zero, all components present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def fit_centroids(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 1e-9, total / np.maximum(n, 1e-9), c)
    return c


def lists_to_probe(x: np.ndarray, c: np.ndarray, k: int, share: float = HELD, tried: int = 500) -> int:
    """How many lists, nearest first, hold the given share of the k nearest of sample rows."""
    q = x[: min(tried, len(x))]
    cos = q @ x.T
    cos[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argpartition(-cos, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(q), 1), np.int64)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    own = (x @ c.T).argmax(1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), share, method="higher")) + 1


def round_ends(units: int) -> list[int]:
    """How many segments a query has met after each round, if it has ``units`` at most."""
    if units <= FIRST:
        return [units]
    more = int(np.ceil(np.log(units / FIRST) / np.log(WIDER) - 1e-9))
    return [FIRST, *(int(np.ceil(FIRST * (units / FIRST) ** (i / more))) for i in range(1, more)), units]


def scan(queries: np.ndarray, rows: np.ndarray, want: int, tile: tuple[int, int] = (256, 4096), bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that survive the adaptive scan of rotated unit vectors.

    A query's bound is the want-th smallest whole distance among the rows seen so far, ``bounds``
    before any. While most pairs of a tile are alive, a block's distances come from one product;
    then from the pairs alone.
    """
    dims, out = queries.shape[1], []
    cuts = list(range(0, dims, BLOCK))
    for q0 in range(0, len(queries), tile[0]):
        q = queries[q0 : q0 + tile[0]]
        bound = np.full(len(q), np.inf) if bounds is None else bounds[q0 : q0 + tile[0]].copy()
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for x0 in range(0, len(rows), tile[1]):
            x = rows[x0 : x0 + tile[1]]
            dist, pairs = np.zeros((len(q), len(x)), np.float32), None
            for d in cuts:
                qd, xd = q[:, d : d + BLOCK], x[:, d : d + BLOCK]
                if pairs is None:
                    dist += (qd * qd).sum(1)[:, None] + (xd * xd).sum(1)[None] - 2 * (qd @ xd.T)
                else:
                    diff = qd[pairs[0]] - xd[pairs[1]]
                    dist = dist + np.einsum("ij,ij->i", diff, diff)
                seen = min(d + BLOCK, dims)
                limit = bound * (1 + EPSILON / seen**0.5) ** 2 * seen / dims + 1e-5 if seen < dims else bound + 1e-5
                if pairs is None:
                    alive = dist <= limit[:, None]
                    if seen == dims or alive.sum() <= SPARSE * alive.size:
                        pairs = np.nonzero(alive)
                        dist = dist[pairs]
                else:
                    alive = dist <= limit[pairs[0]]
                    pairs, dist = (pairs[0][alive], pairs[1][alive]), dist[alive]
            at, by, far = (np.concatenate(z) for z in zip(best, (pairs[0], pairs[1] + x0, dist), strict=True))
            order = np.lexsort((far, at))
            at, by, far = at[order], by[order], far[order]
            first = np.searchsorted(at, np.arange(len(q)))
            place = np.arange(len(at)) - first[at]
            full = np.bincount(at, minlength=len(q)) >= want
            bound[full] = np.minimum(bound[full], far[first[full] + want - 1])
            keep = (place < want) | (far <= bound[at] + 1e-5)
            best = at[keep], by[keep], far[keep]
        out.append((best[0] + q0, best[1]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A column of equally long lists of numbers as rows of doubles."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for p in parts]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest others of each query row.

    ``queries`` is a predicate on the rows. Vectors that are null, zero, or have null or
    non-finite components take no part, nor do null ids or vectors of another length than most.
    Rows that repeat an id are one if their vectors are equal. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), queries.alias("q")).where(valid(F.col("v")) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    dims = sizes.d
    rows = rows.where(F.size("v") == dims).withColumn("h", F.xxhash64("v"))
    # Equal vectors enter once, with the k + 1 smallest ids: more of them never show in a result.
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = rows.select("id", "v", "h").groupBy("h", "id", "v").agg(F.lit(1).alias("x")).withColumn("place", place).where(F.col("place") <= k + 1)
    # A vector is known by its hash and its smallest id: no two distinct ones have both alike.
    distinct = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("one", F.element_at("ids", 1))
    distinct = materialize(distinct, "vectors")
    total = distinct.count()
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = np.array(distinct.where(draw).orderBy("h", "one").select("v").toPandas()["v"].tolist() or [[1.0] * dims], dtype=np.float64)
    sample = _units(sample).astype(np.float32)
    lists = int(max(1, min(total // LIST_ROWS, len(sample) // 8)))
    centroids, turn = fit_centroids(sample, lists).astype(np.float32), rotation(dims)
    probes = min(lists, max(MIN_PROBED, lists_to_probe(sample, centroids, k)))

    @F.arrow_udf("int")
    def own_list(vs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in vs:
            yield pa.array((_units(_matrix(v, dims)).astype(np.float32) @ centroids.T).argmax(1).astype(np.int32))

    index = materialize(distinct.select("h", "one", "v", own_list("v").alias("list")), "index")
    # One row for each list, SAMPLE / 8 at most.
    segments = {r.list: -(-r.n // SEGMENT) for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # Segments are numbered through all lists.
    sizes_by_list = np.array([segments.get(i, 0) for i in range(lists)], dtype=np.int64)
    firsts = np.cumsum(sizes_by_list) - sizes_by_list
    begin, count = (F.create_map(*(F.lit(int(x)) for i in segments for x in (i, by[i])))[F.col("list")] for by in (firsts, segments))
    index = index.select("h", "one", "v", (begin + F.pmod("h", count)).cast("int").alias("segment"))

    def nearest_segments(most: int):
        @F.arrow_udf("array<int>")
        def probed(vs: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for v in vs:
                near = np.argsort(-(_units(_matrix(v, dims)).astype(np.float32) @ centroids.T), axis=1, kind="stable")[:, :most]
                n = sizes_by_list[near]
                flat, each_n = near.ravel(), n.ravel()
                numbers = np.repeat(firsts[flat] - (np.cumsum(each_n) - each_n), each_n) + np.arange(each_n.sum())
                yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n.sum(1))).astype(np.int32)), pa.array(numbers.astype(np.int32)))

        return probed

    each = rows.where("q").select(F.col("id").alias("query_id"), "h", "v").distinct()
    asked = materialize(distinct.join(each.select("h", "v").distinct(), ["h", "v"]).select("h", "one", "v"), "queries")
    blocks = -(-asked.count() // QUERIES)

    def within(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64), np.empty(0, np.int64)
        if candidates.num_rows and wanted.num_rows:
            x, q = _matrix(candidates.column("v"), dims), _matrix(wanted.column("v"), dims)
            least = wanted.column("least").to_numpy()
            bounds = np.where(np.isnan(least), np.inf, 2 - 2 * least)
            found = scan((_units(q) @ turn).astype(np.float32), (_units(x) @ turn).astype(np.float32), k + 1, bounds=bounds)
            a, b = q[found[0]], x[found[1]]
            score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        else:
            score = np.empty(0)
        of, to = pa.array(found[0]), pa.array(found[1])
        return pa.table({"qh": wanted.column("h").take(of), "qone": wanted.column("one").take(of), "h": candidates.column("h").take(to), "one": candidates.column("one").take(to), "score": pa.array(score)})

    def meet(some: DataFrame, most: int) -> DataFrame:
        """The k + 1 best vectors of each of some queries in its ``most`` nearest lists."""
        probing = some.select("h", "one", "v", F.pmod(F.xxhash64("one", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.posexplode(nearest_segments(most)("v")).alias("near", "segment"))
        probing = materialize(probing, "probing")
        best = F.row_number().over(Window.partitionBy("qh", "qone").orderBy(F.desc("score"), "one", "h"))
        met, found = 0, None
        for end in round_ends(int(np.sort(sizes_by_list)[::-1][:most].sum())):
            now, met = probing.where((F.col("near") >= met) & (F.col("near") < end)).drop("near"), end
            if found is None:
                now = now.withColumn("least", F.lit(float("nan")))
            else:
                full = found.groupBy("qh", "qone").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") > k)
                now = now.join(full.select(F.col("qh").alias("h"), F.col("qone").alias("one"), "least"), ["h", "one"], "left").withColumn("least", F.coalesce("least", F.lit(float("nan"))))
            groups = now.select("segment", "block").distinct().toDF("_segment", "_block")
            dealt = index.join(groups, index["segment"] == groups["_segment"])
            pairs = dealt.groupBy("_segment", "_block").cogroup(now.groupBy("segment", "block")).applyInArrow(within, "qh bigint, qone bigint, h bigint, one bigint, score double")
            every = pairs if found is None else pairs.unionByName(found)
            found = materialize(every.withColumn("r", best).where(F.col("r") <= k + 1).drop("r"), "found")
        return found

    found = meet(asked, probes)
    if probes < lists:
        enough = found.groupBy("qh", "qone").agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col("qh").alias("h"), F.col("qone").alias("one"))
        short = materialize(asked.join(enough, ["h", "one"], "left_anti"), "short")
        if not short.isEmpty():
            keys = short.select(F.col("h").alias("qh"), F.col("one").alias("qone"))
            found = found.join(keys, ["qh", "qone"], "left_anti").unionByName(meet(short, lists))
    # The ids behind the vectors; each query row leaves out its own.
    named = found.join(distinct.select("h", "one", "ids"), ["h", "one"]).select("qh", "qone", "score", F.explode("ids").alias("id"))
    pick = Window.partitionBy("qh", "qone").orderBy(F.desc("score"), "id")
    named = named.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= k + 1).groupBy("qh", "qone").agg(F.collect_list(F.struct("score", "id")).alias("near"))
    keyed = asked.join(named, [asked["h"] == named["qh"], asked["one"] == named["qone"]]).select("h", "v", "near")
    flat = each.join(keyed, ["h", "v"]).select("query_id", F.explode("near").alias("x")).select("query_id", "x.score", "x.id").where("id <> query_id")
    best = flat.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
