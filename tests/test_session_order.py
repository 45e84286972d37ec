"""Which of equal messages a backfill keeps, wherever the table's rows lie."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from memspark.jobs import catalog, stores


def test_first_of_equal_messages_stays(spark, tmp_path):
    said = spark.range(60).select((F.lit(60) - F.col("id")).alias("conv_id"), F.lit(1).cast("bigint").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("with the same words "), F.col("id").cast("int") % 3).alias("text"))
    said.repartitionByRange(6, F.desc("conv_id")).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("documents", "supplier", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(20).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("conversations", "documents", "supplier", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cols = "id, source, signal_weight, is_correction"
    want = con.sql(f"SELECT {cols} FROM ({catalog.ORACLES['a9_project_backfill']})").fetchall()
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = [tuple(r) for r in stores.a9_project_backfill(spark, str(tmp_path)).select(*cols.split(", ")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(want) and sum(r[1] == "claude_code" for r in got) == 3
