"""Structured Streaming jobs: damping per key, novel items of a session, deduplication by content, late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from memspark.session import scratch_path, ship_package

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into files of the shared folder, and read them."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parquet*")


def dedup_stream(rows: DataFrame, key: Column, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withColumn("id", key).withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(rows: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of each key in tumbling windows of event time, late rows dropped."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def damped_stream(rows: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """At most ``cap`` deliveries of each key, counted in keyed state; only deliveries count.

    Within a micro-batch a key's rows are taken in the given order. Rows with a null first key have
    no cap and no number, and don't meet the state.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    ship_package(rows.sparkSession)
    columns = rows.columns

    class Cap(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.count = handle.getValueState("count", "n int")

        def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            n = self.count.get()[0] if self.count.exists() else 0
            if n >= cap:
                return
            best = pd.DataFrame(columns=columns)
            for b in batches:  # never more than cap rows are held
                best = pd.concat([best, b[columns]] if len(best) else [b[columns]]).sort_values(order).head(cap - n)
            if len(best):
                best["delivery"] = range(n + 1, n + len(best) + 1)
                self.count.update((n + len(best),))
                yield best

        def close(self) -> None:
            pass

    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    schema = T.StructType([*rows.schema.fields, T.StructField("delivery", T.IntegerType())])
    capped = rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).transformWithStateInPandas(Cap(), schema, "append", "none")
    return capped.unionByName(rows.where(F.col(keys[0]).isNull()).withColumn("delivery", F.lit(None).cast("int")))


def first_novel_stream(calls: DataFrame, ttl_ms: int) -> DataFrame:
    """Streamed calls (session_id, pos, call_id, near: array of (rank, id)) -> (session_id, call_id, id): each call's best item that its session wasn't shown.

    What a session was shown is keyed state that expires ``ttl_ms`` after it was shown; until then any
    split of the calls into batches gives what one fold over them gives. Calls without a session show
    nothing. Under an availableNow trigger spark.sql.streaming.noDataMicroBatches.enabled must be off: expiry
    by the clock would ask for batches without data for ever.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    ship_package(calls.sparkSession)
    kinds = {f.name: f.dataType for f in calls.schema}
    item = kinds["near"].elementType["id"].dataType.simpleString()

    class Novel(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.shown = handle.getMapState("shown", f"id {item}", "yes boolean", ttl_ms)

        def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            out = []
            part = pd.concat(list(batches)).sort_values(["pos", "call_id"])
            for call, near in zip(part["call_id"], part["near"], strict=True):
                for x in sorted(near, key=lambda x: x["rank"]):
                    if not self.shown.containsKey((x["id"],)):
                        self.shown.updateValue((x["id"],), (True,))
                        out.append((key[0], call, x["id"]))
                        break
            yield pd.DataFrame(out, columns=["session_id", "call_id", "id"])

        def close(self) -> None:
            pass

    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    schema = f"session_id {kinds['session_id'].simpleString()}, call_id {kinds['call_id'].simpleString()}, id {item}"
    return calls.where("session_id is not null").groupBy("session_id").transformWithStateInPandas(Novel(), schema, "append", "processingTime")
