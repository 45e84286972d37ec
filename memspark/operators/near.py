"""Exact nearest vectors with pruning by pivots and the triangle inequality.

A few vectors are pivots; every vector lies in the segment of its nearest one, at a known distance
from it. A query's distance to a pivot bounds its distance to all vectors of that segment from both sides:
segments, and within a segment vectors, that the bounds keep beyond the k-th best found so far are
never compared. The first threshold comes from the query's nearest segments that hold k vectors.
Segments are cut into blocks, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from memspark.session import materialize, ship_package

PIVOTS = 64
#: Vectors of one block.
BLOCK = 20_000
_SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L2 distances of one vector to each of many."""
    return np.sqrt(((b - a) ** 2).sum(1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, distance), (query_id, compared)): at least the k nearest vectors by L2 of each query (query_id, vector), and how many it was compared with.

    Only vectors of a query's length count; null vectors, and those with null or non-finite components, take no part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    fine = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = vectors.schema[id_col].dataType.simpleString()
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine("v")).withColumn("size", F.size("v"))
    asked = materialize(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where(fine("q")).withColumn("size", F.size("q")), "query_vectors")
    own = own.join(asked.select("size").distinct(), "size", "left_semi")
    # Pivots of each length, taken by hash; so many vectors reach the driver for each length that queries have.
    some = own.groupBy("size", F.pmod(F.xxhash64("v", "id"), F.lit(1000)).alias("h")).agg(F.min_by("v", "id").alias("v"))
    told = some.withColumn("_m", F.row_number().over(Window.partitionBy("size").orderBy("h"))).where(F.col("_m") <= pivots)
    centres = {}
    for r in told.select("size", "v").collect():
        centres.setdefault(r["size"], []).append(r["v"])
    centres = {s: np.array(v) for s, v in centres.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            for s in np.unique(size).tolist():
                part = b.take(pa.array(np.flatnonzero(size == s)))
                far = np.stack([_far(c, _matrix(part.column("v"))) for c in centres[s]])
                at = far.argmin(0)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("size"), pa.array(at.astype(np.int32)), pa.array(far[at, np.arange(len(at))])], names=["id", "v", "size", "pivot", "r"])

    placed = materialize(own.select("id", "v", "size").mapInArrow(assign, f"id {kind}, v array<double>, size int, pivot int, r double"), "segments")
    stats = {(x["size"], x["pivot"]): (x["n"], x["low"], x["high"]) for x in placed.groupBy("size", "pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    blocks = max([1, *(-(-n // block) for n, _, _ in stats.values())])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    query_kind = asked.schema["query_id"].dataType.simpleString()

    def probes(rows: DataFrame, again: bool) -> DataFrame:
        """(query_id, q, size, pivot, d, floor): the segments that a query looks into; at first its nearest ones with k vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, pivot, ds, floors = [], [], [], []
                for i, (q, s) in enumerate(zip(b.column("q"), b.column("size").to_pylist(), strict=True)):
                    if s not in centres:
                        continue
                    d = _far(np.array(q.values), centres[s])
                    there = [p for p in range(len(d)) if (s, p) in stats]
                    n, low, high = (np.array([stats[s, p][j] for p in there]) for j in range(3))
                    near = d[there]
                    order = np.argsort(near + high)
                    enough = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                    floor = float((near + high)[order][: enough][-1]) if n.sum() >= k else np.inf
                    if again:
                        found = b.column("floor")[i].as_py()
                        floor = min(floor, found) if found is not None else floor
                        some = np.flatnonzero(np.maximum(near - high, low - near) <= floor * (1 + _SLACK) + _SLACK)
                    else:
                        some = order[:enough]
                    for j in some.tolist():
                        at.append(i)
                        pivot.append(there[j])
                        ds.append(near[j])
                        floors.append(floor)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(rows), b.column("q").take(rows), b.column("size").take(rows), pa.array(pivot, pa.int32()), pa.array(ds, pa.float64()), pa.array(floors, pa.float64())], names=["query_id", "q", "size", "pivot", "d", "floor"])

        return rows.mapInArrow(run, f"query_id {query_kind}, q array<double>, size int, pivot int, d double, floor double")

    def compared(asked: DataFrame) -> DataFrame:
        """(query_id, id, distance, n): of each block the k best for each query, n the vectors it was compared with."""

        def run(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
            out = []
            if len(vectors) and len(wanted):
                rows, r = _matrix(vectors["v"].combine_chunks()), vectors["r"].to_numpy()
                for name, q, d, floor in zip(wanted["query_id"].to_pylist(), wanted["q"], wanted["d"].to_pylist(), wanted["floor"].to_pylist(), strict=True):
                    near = np.flatnonzero(np.abs(r - d) <= floor * (1 + _SLACK) + _SLACK)
                    far = _far(np.array(q.values), rows[near])
                    best = np.sort(far)[min(k, len(far)) - 1] if len(far) else 0.0
                    keep = np.flatnonzero(far <= best + _SLACK)  # ties at the end are settled with all blocks
                    out.append((name, near[keep], far[keep], len(near)))
            at = np.concatenate([x[1] for x in out]) if out else np.zeros(0, dtype=np.int64)
            ids = vectors["id"].take(pa.array(at)) if len(vectors) else pa.chunked_array([], vectors.schema.field("id").type)
            names = pa.array([x[0] for x in out for _ in x[1]], wanted.schema.field("query_id").type)
            n = pa.array([len_ if not j else 0 for _, some, _, len_ in out for j in range(len(some))], pa.int64())
            return pa.table([names, ids, pa.array(np.concatenate([x[2] for x in out]) if out else np.zeros(0)), n], names=["query_id", "id", "distance", "n"])

        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["size", "pivot", "block"]
        return placed.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(run, f"query_id {query_kind}, id {kind}, distance double, n bigint")

    begun = materialize(compared(probes(asked, False)), "first_near")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
    floors = begun.withColumn("_n", nth).where(F.col("_n") == k).select("query_id", F.col("distance").alias("floor"))
    all_ = materialize(compared(probes(asked.join(floors, "query_id", "left"), True)), "near")
    counts = begun.select("query_id", "n").unionByName(all_.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("compared"))
    return all_.select("query_id", "id", "distance"), counts
