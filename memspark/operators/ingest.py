"""Incremental ingestion as one flow: what changed in Markdown folders and what was appended to logs, source by source under one deadline.

The store is a folder that driver and executors share. A wave, some files of one source, adds a part
with its chunks and then a part of the manifest; nothing is rewritten. A chunk counts while the wave
that wrote it is the latest that read its file, so files are replaced as wholes, and a wave that died
before its manifest was written counts for nothing and is written again.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from memspark.functions import classify, lexicon
from memspark.functions.text import content_id, derive_aliases, detect_module, split_sections
from memspark.operators.ranks import placed
from memspark.session import materialize, ship_package
from memspark.sources import appended, readers

CHUNKS = "id string, source string, file_path string, section int, part int, content string, line_start int, line_end int, role string, session_id string, date string, module string, signal_weight int, is_correction boolean, is_decision boolean, do_not_rebuild boolean, aliases string, wave int"
MANIFEST = "source string, file_path string, mtime timestamp, chunks_added bigint, error string, wave int"


@dataclass(frozen=True)
class Files:
    """A source of Markdown files below a folder; ``front_matter`` is cut off, ``weight`` and ``correction`` come from the path."""

    name: str
    folder: str
    weight: Callable[[Column], Column] = classify.doc_signal_weight
    correction: Callable[[Column], Column] = lambda path: F.lit(False)
    front_matter: bool = False
    pattern: str = "*.md"


@dataclass(frozen=True)
class Logs:
    """A source of session logs that grow; options are those of ``appended_lines``."""

    name: str
    folder: str
    weight: int = 10
    options: dict[str, str] = field(default_factory=dict)


def uri(path: str) -> str:
    """A path as Spark names it, as pyarrow wants it."""
    return re.sub(r"^file:/(?!/)", "file:///", path) if path.startswith("file:") else path if "://" in path else f"file://{path}"


def _parts(state: str, kind: str) -> list[str]:
    """The names of the written parts of a kind, in order."""
    fs, path = pafs.FileSystem.from_uri(uri(f"{state}/{kind}"))
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(f.path.rsplit("/", 2)[1] for f in found if f.base_name == "_SUCCESS")


def _read(spark: SparkSession, state: str, kind: str, names: list[str], schema: str) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{state}/{kind}/{n}" for n in names))


def manifest(spark: SparkSession, state: str) -> DataFrame:
    """(source, file_path, mtime, chunks_added, error, wave): every reading of a file, failed ones with their error."""
    return _read(spark, state, "manifest", _parts(state, "manifest"), MANIFEST)


def stored(spark: SparkSession, state: str, but: str | None = None) -> DataFrame:
    """The chunks that count now; ``but`` names a part of the logs to leave out."""
    names = _parts(state, "manifest")
    latest = _read(spark, state, "manifest", names, MANIFEST).where("error is null").groupBy("file_path").agg(F.max("wave").alias("wave"))
    own = _read(spark, state, "chunks", names, CHUNKS).join(latest, ["file_path", "wave"], "left_semi")
    lines = _read(spark, state, "logs", [n for n in _parts(state, "logs") if n != but], CHUNKS)
    return own.unionByName(lines)


def listed(spark: SparkSession, source: Files, skipped: list[str]) -> DataFrame:
    """(file_path, mtime) of a source's files; a folder that isn't there has none. Contents aren't read."""
    fs, path = pafs.FileSystem.from_uri(uri(source.folder))
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return spark.createDataFrame([], "file_path string, mtime timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", source.pattern).load(source.folder)
    return files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("mtime")).where(~classify.path_is_skipped(F.col("file_path"), skipped))


def due(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (file_path, mtime) that are to be read, by a source's own manifest.

    The watermark is the newest time that was read, but never later than a file of the listing whose
    last reading failed. Files older than it are passed over; of the others those that were read at
    their present time. So files that share the newest time, or follow a failed one, are read once.
    """
    last = seen.groupBy("file_path").agg(F.max_by(F.struct("mtime", "error"), "wave").alias("r")).select("file_path", "r.*")
    failed = last.where("error is not null").join(files.select("file_path"), "file_path", "left_semi")
    mark = last.where("error is null").agg(F.max("mtime").alias("_m")).crossJoin(failed.agg(F.min("mtime").alias("_f"))).select(F.least("_m", "_f").alias("_mark"))
    done = last.where("error is null").select("file_path", "mtime")
    rows = files.crossJoin(mark).where(F.col("_mark").isNull() | (F.col("mtime") >= F.col("_mark"))).drop("_mark")
    return rows.join(done, ["file_path", "mtime"], "left_anti")


def read_files(files: DataFrame) -> DataFrame:
    """(file_path, mtime, place, text, error) of files; one that can't be read has an error instead of a text."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, mtime, place in b[["file_path", "mtime", "place"]].itertuples(index=False):
                text = error = None
                try:
                    scheme, rest = path.split(":", 1) if ":" in path else ("file", path)
                    fs, name = (pafs.LocalFileSystem(), re.sub("^/+", "/", rest)) if scheme == "file" else pafs.FileSystem.from_uri(path)
                    with fs.open_input_stream(name) as f:
                        text = f.read().decode("utf-8", "replace")
                except (OSError, ValueError) as e:  # gone, moved or not allowed since it was listed
                    error = (str(e) or type(e).__name__)[:2000]
                yield pd.DataFrame({"file_path": [path], "mtime": [mtime], "place": [place], "text": [text], "error": [error]})

    return files.select("file_path", "mtime", "place").mapInPandas(run, "file_path string, mtime timestamp, place bigint, text string, error string")


def graded(rows: DataFrame, source: Files, roster: list[str], kept_modules: list[str]) -> DataFrame:
    """Sections (content, file_path, ...) as chunks of a source, with the tags that content and path give."""
    text = F.col("content")
    module = detect_module(text, roster)
    marked = F.coalesce(module.isin(kept_modules), F.lit(False)) | classify.is_do_not_rebuild(text)
    return rows.withColumns({
        "id": content_id(text), "source": F.lit(source.name), "module": module, "signal_weight": source.weight(F.col("file_path")).cast("int"),
        "is_correction": source.correction(F.col("file_path")), "is_decision": classify.is_decision(text), "do_not_rebuild": marked, "aliases": derive_aliases(text),
    })


def _as_chunks(rows: DataFrame, wave: int) -> DataFrame:
    wanted = [c.split(" ", 1) for c in CHUNKS.split(", ")]
    have = {*rows.columns}
    return rows.withColumn("wave", F.lit(wave)).select(*((F.col(n) if n in have | {"wave"} else F.lit(None)).cast(t).alias(n) for n, t in wanted))


def admitted_chunks(fresh: DataFrame, files: DataFrame, before: DataFrame) -> DataFrame:
    """Of fresh chunks (id, file_path, place, section, part) those to store; ``before`` (id, file_path) is stored, ``files`` (file_path, place) are read again.

    The outcome is that of taking the files one after the other by place, dropping a file's old chunks
    before its new ones, and passing over a content that is stored at that time.
    """
    owner = before.select("id", F.col("file_path").alias("_owner")).join(files.select(F.col("file_path").alias("_owner"), F.col("place").alias("_at")), "_owner", "left")
    free = fresh.join(owner, "id", "left").where("_owner is null or place >= _at")
    first = Window.partitionBy("id").orderBy("place", "section", "part")
    return free.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_owner", "_at")


def _wave(spark: SparkSession, state: str, source: Files, files: DataFrame, number: int, roster: list[str], kept_modules: list[str]) -> tuple[int, int, int]:
    """Read and store one wave; (files ingested, files failed, chunks added)."""
    texts = materialize(read_files(files), "texts")
    read = texts.where("error is null")
    body = readers.body(F.col("text")) if source.front_matter else F.col("text")
    pieces = split_sections(read.select(F.struct("file_path", "place").alias("file"), body.alias("text")), "file", "text")
    pieces = pieces.select("file.file_path", "file.place", "section", "part", F.col("text").alias("content"), "line_start", "line_end")
    name = f"w{number:08d}"
    new = admitted_chunks(graded(pieces, source, roster, kept_modules), read, stored(spark, state))
    _as_chunks(new, number).write.mode("overwrite").parquet(f"{state}/chunks/{name}")
    added = _read(spark, state, "chunks", [name], CHUNKS).groupBy("file_path").agg(F.count("*").alias("chunks_added"))
    rows = texts.join(added, "file_path", "left").select(F.lit(source.name).alias("source"), "file_path", "mtime", F.coalesce("chunks_added", F.lit(0)).cast("bigint").alias("chunks_added"), "error", F.lit(number).alias("wave"))
    rows.write.mode("overwrite").parquet(f"{state}/manifest/{name}")
    told = _read(spark, state, "manifest", [name], MANIFEST).agg(F.count_if(F.col("error").isNull()), F.count("error"), F.sum("chunks_added")).first()
    return told[0], told[1], told[2] or 0


def _logs(spark: SparkSession, state: str, source: Logs, seconds: float, roster: list[str]) -> int:
    """Store what was appended to a source's logs, for ``seconds`` at most; the number of chunks added."""
    spark.dataSource.register(appended.AppendedLines)
    ship_package(spark)
    lines = spark.readStream.format("appended_lines").options(**{"ledger": f"{uri(state)}/{source.name}.ledger.json", "seconds": str(seconds), **source.options}).load(uri(source.folder))
    m = readers.message_fields(lines, "", True).where(F.col("text").isNotNull() & (F.trim("text") != "") & classify.harness_reason(F.col("text")).isNull())
    text = F.col("content")
    rows = m.select(F.col("text").alias("content"), "role", "session_id", F.col("ts").alias("date"), F.col("start_offset").alias("_at"))
    rows = rows.withColumns({"id": content_id(text), "source": F.lit(source.name), "module": detect_module(text, roster), "signal_weight": F.lit(source.weight), "is_decision": classify.is_decision(text), "aliases": derive_aliases(text)})
    counts = []

    def store(batch: DataFrame, number: int) -> None:
        name = f"{source.name}-{number:08d}"  # a batch that runs again writes its part again
        first = Window.partitionBy("id").orderBy("session_id", "_at")
        new = batch.withColumn("_r", F.row_number().over(first)).where("_r = 1").join(stored(spark, state, but=name).select("id"), "id", "left_anti")
        _as_chunks(new, -1).write.mode("overwrite").parquet(f"{state}/logs/{name}")
        counts.append(_read(spark, state, "logs", [name], CHUNKS).count())

    rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{state}/{source.name}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sum(counts)


def run(spark: SparkSession, state: str, sources: list[Files | Logs], roster: list[str], kept_modules: list[str] = (), budget_s: float = 55.0, wave_files: int = 10_000, clock: Callable[[], float] = time.monotonic, skipped: list[str] = lexicon.SKIPPED_FOLDERS) -> DataFrame:
    """One run over all sources in their given order; (source, files_ingested, files_skipped, files_failed, files_left, chunks_added).

    One deadline holds for all sources and is looked at before each wave of ``wave_files`` files and
    each log source: at a budget of 0 nothing is ingested. Files come by time, then path, so that
    what a run leaves is above the watermark and comes next. Only one run may write a store at a time.
    """
    end, out = clock() + budget_s, []
    for source in sources:
        if isinstance(source, Logs):
            left = end - clock()
            out.append((source.name, None, None, None, None, _logs(spark, state, source, left, roster) if left > 0 else 0))
            continue
        if clock() >= end:
            out.append((source.name, 0, 0, 0, None, 0))
            continue
        files = listed(spark, source, list(skipped))
        todo = placed(due(files, manifest(spark, state).where(F.col("source") == source.name)), [], ["mtime", "file_path"])
        todo = materialize(todo, "todo")
        n, total, read, failed, added, done = todo.count(), files.count(), 0, 0, 0, 0
        while done < n and clock() < end:
            number = int((_parts(state, "manifest") or ["w0"])[-1][1:]) + 1
            got = _wave(spark, state, source, todo.where(F.col("place").between(done + 1, done + wave_files)), number, list(roster), list(kept_modules))
            read, failed, added, done = read + got[0], failed + got[1], added + got[2], min(n, done + wave_files)
        out.append((source.name, read, total - n + failed, failed, n - done, added))
    return spark.createDataFrame(out, "source string, files_ingested bigint, files_skipped bigint, files_failed bigint, files_left bigint, chunks_added bigint")


@dataclass(frozen=True)
class Project:
    """Where a project's records lie, as paths that Spark reads; what is None has none."""

    sessions: str | None = None
    docs: str | None = None
    memory: str | None = None
    experiments: str | None = None
    git: str | None = None


def backfill(spark: SparkSession, project: Project, roster: list[str], kept_modules: list[str] = (), corrections: list[str] = lexicon.CORRECTION_PHRASES, decisions: list[str] = lexicon.DECISION_PHRASES, investigations: list[str] = lexicon.INVESTIGATION_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(chunks, counts) of all that a project has so far: sessions, docs, memory, experiments, git, in this order.

    Of equal contents the first in that order, then by path and place, stays. Harness messages and
    messages of no weight stay out; counts (source, n_read, n_harness, n_weightless).
    """
    found, counts = [], []  # (source, rows), counts
    if project.sessions:
        rows = readers.sessions(spark, project.sessions).withColumnRenamed("text", "content")
        weight = classify.signal_weight(F.col("content"), F.col("role"), corrections, decisions, investigations)
        rows = rows.withColumns({"_harness": classify.harness_reason(F.col("content")).isNotNull(), "signal_weight": weight})
        counts.append(rows.agg(F.lit("claude_code").alias("source"), F.count("*").alias("n_read"), F.count_if("_harness").alias("n_harness"), F.count_if(~F.col("_harness") & (F.col("signal_weight") == 0)).alias("n_weightless")))
        own = rows.where(~F.col("_harness") & (F.col("signal_weight") > 0)).select("content", "role", "session_id", F.col("ts").alias("date"), F.col("path").alias("_path"), "signal_weight", classify.is_correction(F.col("content"), F.col("role"), corrections).alias("is_correction"))
        found.append(("claude_code", own.withColumns({"_rank": F.lit(0), "_at": F.lit(0).cast("long")})))
    for rank, name, path in ((1, "doc", project.docs), (2, "memory", project.memory)):
        if path:
            own = (readers.markdown_sections if name == "doc" else readers.memory_files)(spark, path).withColumnsRenamed({"text": "content", "path": "file_path"}).drop("meta")
            weight = classify.doc_signal_weight(F.col("file_path")) if name == "doc" else F.lit(40)
            curated = classify.is_curated_correction(F.col("file_path")) if name == "memory" else F.lit(False)
            found.append((name, own.withColumns({"signal_weight": weight, "is_correction": curated, "_rank": F.lit(rank), "_path": F.col("file_path"), "_at": F.col("line_start").cast("long") * 1_000_000 + F.col("part")})))
    if project.experiments:
        own = readers.progress_summaries(spark, project.experiments).select(F.col("text").alias("content"), F.col("path").alias("file_path"))
        found.append(("experiment_summary", own.withColumns({"signal_weight": F.lit(30), "_rank": F.lit(3), "_path": F.col("file_path"), "_at": F.lit(0)})))
    if project.git:
        own = readers.git_log(spark, project.git).select(F.col("text").alias("content"), F.concat(F.lit("git:"), F.substring("sha", 1, 12)).alias("file_path"), "date")
        found.append(("git", own.withColumns({"signal_weight": F.lit(15), "_rank": F.lit(4), "_path": F.col("file_path"), "_at": F.lit(0)})))
    if not found:
        raise ValueError("a project without any source")
    none = F.lit(0).cast("bigint")
    counts += [f.agg(F.lit(name).alias("source"), F.count("*").alias("n_read"), none.alias("n_harness"), none.alias("n_weightless")) for name, f in found if name != "claude_code"]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [f.withColumn("source", F.lit(name)) for name, f in found])
    told = reduce(DataFrame.unionByName, counts)
    text = F.col("content")
    module = detect_module(text, list(roster))
    plain = F.col("source").isin("experiment_summary", "git")
    tagged = rows.withColumns({
        "id": content_id(text), "module": F.when(~plain, module), "is_decision": ~plain & classify.is_decision(text, decisions), "aliases": derive_aliases(text),
        "do_not_rebuild": F.col("source").isin("doc", "memory") & (F.coalesce(module.isin(list(kept_modules)), F.lit(False)) | classify.is_do_not_rebuild(text)),
    })
    first = Window.partitionBy("id").orderBy("_rank", "_path", F.coalesce("date", F.lit("")), "_at", "role")
    chosen = tagged.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return _as_chunks(chosen.withColumn("is_correction", F.coalesce("is_correction", F.lit(False))), 0), told


def dry_run(chunks: DataFrame, n: int, path: str, head: int = 120) -> DataFrame:
    """Write the first ``n`` chunks of a backfill as JSON lines (id, source, module, signal_weight, is_correction, head) instead of storing them."""
    order = F.expr("array_position(array('claude_code', 'doc', 'memory', 'experiment_summary', 'git'), source)")
    few = chunks.orderBy(order, F.coalesce("file_path", "session_id"), "line_start", "date", "id").limit(n)
    few = few.select("id", "source", "module", "signal_weight", "is_correction", F.substring("content", 1, head).alias("head"))
    few.coalesce(1).write.mode("errorifexists").json(path)
    return few.sparkSession.read.schema(few.schema).json(path)


def log(spark: SparkSession, state: str) -> DataFrame:
    """(wave, source, file_path, action, chunks_added, detail) of every reading of a file."""
    return manifest(spark, state).select("wave", "source", "file_path", F.when(F.col("error").isNull(), "ingest").otherwise("read_fail").alias("action"), "chunks_added", F.col("error").alias("detail"))
