"""Places of rows within groups of any size, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.session import materialize


def placed(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """Rows with their 1-based place among those of equal keys; a group may be any part of all rows.

    Rows are range-sorted by keys and order and written. A row's place within its range and group
    follows from its number; what stands before the range comes from the counts of (range, group),
    of which a group has one for each range that it lies in. Rows that the order leaves equal come
    in any order; null keys are a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.drop(name).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    own = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    counts = own.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_part", "_first", "_before")
    same = F.shiftright("_at", 33) == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = own.join(counts, same)
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before", *(f"_k{i}" for i in range(len(keys))))
