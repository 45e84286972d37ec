"""Every registered query of the core library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from memspark.jobs import catalog, flows, more, stores  # noqa: F401  register their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    frame = catalog.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    rel = db.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]
    assert got or name == "f3_missing_vectors", "an empty result compares nothing"
