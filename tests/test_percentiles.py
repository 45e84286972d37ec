"""Percentiles of groups with many values over many partitions: the sorted list's, whatever the quantiles come to."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memspark.operators import telemetry


@pytest.mark.parametrize("parts", [7, 40])
def test_percentiles_of_many_values(spark, parts):
    value = F.round(-F.log(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0 + 1e-9) * 50, 2)
    rows = spark.range(0, 300_000, 1, parts).select(F.pmod(F.xxhash64(F.col("id") + 7), F.lit(4)).alias("kind"), value.alias("value"))
    shares = {f"p{i}": i / 40 for i in range(1, 40)}
    got = {r.kind: r.asDict() for r in telemetry.grouped_nearest_rank(rows, ["kind"], "value", shares).collect()}
    want: dict = {}
    for r in rows.collect():
        if r.value:
            want.setdefault(r.kind, []).append(r.value)
    assert set(got) == set(want)
    for kind, values in want.items():
        values.sort()
        assert got[kind] == {"kind": kind, "n": len(values)} | {name: values[min(len(values) - 1, int(len(values) * s))] for name, s in shares.items()}
