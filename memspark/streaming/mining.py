"""Resumable mining: corrections and candidates from session logs that grow.

Lines appended to the logs come from ``appended_lines``; phrases, sentences and gates are Column
expressions on each line. What needs a session's past is state: its last message with text, the
titles that were found, and how many of each kind. Each run takes what was appended since the one
before (or as much as it admits), and runs over a growing log together give what one pass gives. Rows go to ``keyed_rows``,
so that a batch that is run again adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memspark.functions import classify, lexicon
from memspark.functions.text import clip, extract_topic, phrase_any, sentences
from memspark.session import scratch_path, ship_package
from memspark.sources import appended, keyed_rows, readers
from memspark.streaming.jobs import _ROCKS

_FOUND = "session_id string, kind string, tick bigint, place int, title string, text string, context string, date string"


def _candidates(text: Column, kind: str, cues: list[str], shortest: int, title_chars: int, rationale_chars: int) -> Column:
    """A message's sentences with a cue that pass the gate, in order: (kind, title, rationale)."""
    hits = F.filter(sentences(text), lambda s: phrase_any(s, cues))
    told = F.transform(hits, lambda s: F.struct(F.lit(kind).alias("kind"), clip(s, title_chars).alias("title"), clip(s, rationale_chars).alias("rationale")))
    return F.filter(told, lambda x: classify.gate_reason(x["title"], shortest).isNull())


def mined(lines: DataFrame, corrections: list[str] = lexicon.CORRECTION_PHRASES, decisions: list[str] = lexicon.DECISION_CUES, dead_ends: list[str] = lexicon.DEAD_END_CUES, shortest: int = 40, cap: int = 25, title_chars: int = 200, rationale_chars: int = 600) -> DataFrame:
    """Streamed lines (session_id, start_offset, value) -> (session_id, kind, tick, place, title, text, context, date).

    A ``correction`` has a person's message as its text and the answer before it as context; tick is its
    line's first byte. A ``decision`` or ``dead_end`` has a title, its sentence, and its place among
    those of its session and kind, at most ``cap``; a title counts once. Harness rows don't fire
    and are skipped by candidates, but are the message before the next. Lines without text don't count.
    A micro-batch's lines of one session are sorted in one task: the source's ``bytes`` bounds them.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    spark = lines.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    m = readers.message_fields(lines).where("text is not null")
    own = classify.harness_reason(F.col("text")).isNull()
    kept = own & ~classify.is_maintenance(F.col("text"))
    each = F.concat(_candidates(F.col("text"), "decision", decisions, shortest, title_chars, rationale_chars), _candidates(F.col("text"), "dead_end", dead_ends, shortest, title_chars, rationale_chars))
    rows = m.select("session_id", F.col("start_offset").alias("tick"), "role", "text", F.substring("ts", 1, 10).alias("date"), (own & (F.col("role") == "user") & phrase_any(F.col("text"), corrections)).alias("corrects"), F.when(kept, each).alias("found"))

    class Miner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "role string, text string")
            self.titles = handle.getMapState("titles", "kind string, title string", "seen boolean")
            self.counts = handle.getMapState("counts", "kind string", "n int")

        def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            part = pd.concat(list(batches)).sort_values("tick")
            role, text = self.last.get() if self.last.exists() else (None, "")
            counts, out = {k: (self.counts.getValue((k,))[0] if self.counts.containsKey((k,)) else 0) for k in ("decision", "dead_end")}, []
            for tick, now, said, date, corrects, found in zip(*(part[c] for c in ("tick", "role", "text", "date", "corrects", "found")), strict=True):
                if corrects and role == "assistant":
                    out.append((key[0], "correction", tick, None, None, said, text, date))
                for x in found if found is not None else ():
                    kind, title = x["kind"], x["title"]
                    if counts[kind] < cap and not self.titles.containsKey((kind, title)):
                        self.titles.updateValue((kind, title), (True,))
                        counts[kind] += 1
                        out.append((key[0], kind, tick, counts[kind], title, x["rationale"], None, date))
                role, text = now, said
            self.last.update((role, text))
            for k, n in counts.items():
                self.counts.updateValue((k,), (n,))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])
            yield frame.astype({"place": "Int32", "tick": "int64"})

        def close(self) -> None:
            pass

    return rows.groupBy("session_id").transformWithStateInPandas(Miner(), _FOUND, "append", "none")


def mine(spark: SparkSession, folder: str, state: str, options: dict[str, str] | None = None, **rules) -> DataFrame:
    """One run over the logs below ``folder`` (a URI); all that was found in this and earlier runs of ``state``.

    ``state`` is a folder that executors share: checkpoint, ledger and rows lie there. Corrections get their topic.
    """
    spark.dataSource.register(appended.AppendedLines)
    spark.dataSource.register(keyed_rows.KeyedRows)
    lines = spark.readStream.format("appended_lines").options(ledger=f"{state}/ledger.json", **(options or {})).load(folder)
    found = mined(lines, **rules)
    found.writeStream.outputMode("append").format("keyed_rows").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start(f"{state}/rows").awaitTermination()
    rows = keyed_rows.committed(spark, f"{state}/rows", found.schema)
    return rows.withColumn("topic", F.when(F.col("kind") == "correction", extract_topic(F.concat_ws(" ", "text", "context"))))


def write_logs(rows: DataFrame, log: str, order: list[str], line: str, folder: str, suffix: str = ".jsonl") -> None:
    """Write ``{log}{suffix}`` below ``folder`` (a URI that executors share) for each value of ``log``, with its lines in order."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, out = None, None
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != name:
                    if out is not None:
                        out.close()
                    name, out = key, fs.open_output_stream(f"{path}/{key}{suffix}")
                out.write(text.encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int32())})

    ordered = rows.repartition(log).sortWithinPartitions(log, *order).select(F.col(log).cast("string").alias("log"), F.col(line).alias("line"))
    ordered.mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()


def state_folder(spark: SparkSession, name: str) -> str:
    """A fresh state folder in shared scratch space, as a URI."""
    path = scratch_path(spark, name)
    return path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:") else f"file://{path}"
