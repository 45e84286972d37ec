"""Readers of session logs, Markdown, memory files, rosters, progress files and exported git logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memspark.functions.text import WS, split_sections

_BLOCK = "array<struct<type:string,text:string>>"
_RECORD = "timestamp string, type string, role string, message struct<role:string, content:string>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value"))


def _content(joiner: str, only_text_blocks: bool) -> Column:
    raw = F.col("r.message.content")
    blocks = F.from_json(raw, _BLOCK, {"mode": "PERMISSIVE"})
    wanted = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()) if only_text_blocks else F.filter(blocks, lambda b: b["text"].isNotNull())
    return F.when(F.ltrim(raw).startswith("["), F.array_join(F.transform(wanted, lambda b: b["text"]), joiner)).otherwise(raw)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, path, role, text, ts) of session JSONL: text blocks joined without a blank, blank rows gone."""
    r = _lines(spark, path).withColumn("r", F.from_json("value", _RECORD, {"mode": "PERMISSIVE"}))
    rows = r.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("session_id"), "path", F.coalesce("r.message.role", "r.type").alias("role"), _content("", True).alias("text"), F.col("r.timestamp").alias("ts"))
    return rows.where(F.col("text").isNotNull() & (F.regexp_replace("text", WS, "") != ""))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """The same files for mining: any block with text, joined by line ends; unusable rows have a null text."""
    return message_fields(_lines(spark, path).withColumn("session_id", F.regexp_replace("file", r"\.[^.]*$", ""))).select("session_id", "path", "role", "text", "ts")


def message_fields(lines: DataFrame, joiner: str = "\n", only_text_blocks: bool = False) -> DataFrame:
    """Lines with ``value`` as mining reads them: adds role, text (null if unusable) and ts."""
    r = lines.withColumn("r", F.from_json("value", _RECORD, {"mode": "PERMISSIVE"}))
    return r.withColumns({"role": F.coalesce("r.message.role", "r.role", "r.type"), "text": _content(joiner, only_text_blocks), "ts": F.col("r.timestamp")}).drop("r")


def hook_events(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, transcript_path, tool, prompt, tool_input, ok) of event payloads, a JSON object for each line.

    A line that can't be read is an empty event; a session without an id takes its transcript's stem.
    """
    fields = "session_id string, transcript_path string, tool_name string, prompt string, tool_input string"
    r = spark.read.text(path).select(F.from_json("value", fields, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$").isNotNull().alias("ok"))
    stem = F.regexp_replace(F.element_at(F.split(F.col("r.transcript_path"), "[/\\\\]"), -1), r"\.[^.]*$", "")
    return r.select(F.coalesce(F.nullif("r.session_id", F.lit("")), F.nullif(stem, F.lit(""))).alias("session_id"), "r.transcript_path", F.col("r.tool_name").alias("tool"), "r.prompt", "r.tool_input", "ok")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, mtime, text) of text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))


def front_matter(text: Column) -> Column:
    """The key: value lines between --- lines at a file's head, as a map."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[\w-]+:"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---[ \t]*\n?", "")


def h1(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1)), F.lit(""))


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, part, text, line_start, line_end) of Markdown files."""
    return split_sections(whole_files(spark, path), "path", "text")


def memory_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, section, part, text, line_start, line_end): front matter as a map, sections of the body. Files are read once."""
    files = whole_files(spark, path).select(F.struct("path", front_matter(F.col("text")).alias("meta")).alias("file"), body(F.col("text")).alias("text"))
    return split_sections(files, "file", "text").select("file.path", "file.meta", "section", "part", "text", "line_start", "line_end")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row for each progress file: its last valid record; a list of coverage becomes its length."""
    rows = whole_files(spark, path).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.withColumn("v", F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"})).where(F.size("v") > 0)
    last = rows.groupBy("path").agg(F.max_by("line", "n").alias("line"))
    cover = F.get_json_object("line", "$.coverage")
    return last.select("path", "line", F.coalesce(F.json_array_length(cover), F.expr("try_cast(get_json_object(line, '$.coverage') AS int)")).alias("coverage"))


def progress_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): what the last record of each progress file says, in one line; a field that lacks is ``?``."""
    # The fields and their names in the line, in order.
    fields = [("final_tick", "tick"), ("n_completed_tasks", "n_completed_tasks"), ("coverage_total", "coverage_total"), ("coverage_classes", "coverage_classes"), ("ddx_intents_total", "ddx_intents_total")]
    values = []
    for name, key in fields:
        raw = F.get_json_object("line", f"$.{key}")
        values += [F.lit(f" {name}="), F.coalesce(F.json_array_length(raw).cast("string") if key == "coverage_classes" else F.lit(None), raw, F.lit("?"))]
    folder = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    return progress(spark, path).select("path", F.concat(F.lit("Experiment "), folder, F.lit(":"), *values).alias("text"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, date, text) of a log exported with record separator 0x1e and tabs."""
    rows = spark.read.text(path, lineSep="\x1e").where(F.trim("value") != "")
    p = F.split(F.regexp_replace("value", r"^\s+", ""), "\t", 4)
    subject = F.split(p[3], "\n", 2)
    text = F.concat_ws("\n\n", subject[0], F.nullif(F.btrim(F.try_element_at(subject, F.lit(2)), F.lit("\n ")), F.lit("")))
    return rows.where(F.size(p) == 4).select(p[0].alias("sha"), p[1].alias("author"), p[2].alias("date"), text.alias("text"))


def rosters(spark: SparkSession, path: str, suffix: str = ".state.yaml") -> DataFrame:
    """(module, do_not_rebuild): config_flag of state files, else their stem; the last mention of the mark wins."""
    files = whole_files(spark, path)
    flag = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^config_flag:[ \t]*(\S+)", 1)), F.lit(""))
    stem = F.substring(F.col("name"), F.lit(1), F.length("name") - len(suffix))
    marks = F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^do_not_rebuild:[ \t]*(\w+)"))
    rows = files.where(F.col("name").endswith(suffix)).select(F.coalesce(flag, stem).alias("module"), (F.lower(F.try_element_at(marks, F.lit(-1))) == "true").alias("dnr"))
    return rows.groupBy("module").agg(F.bool_or(F.coalesce("dnr", F.lit(False))).alias("do_not_rebuild"))


def invariants(spark: SparkSession, path: str) -> DataFrame:
    """(name, title) of memory files of type invariant (at the top or below metadata), by file name."""
    files = whole_files(spark, path)
    meta = front_matter(F.col("text"))
    kind = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^\s*type:[ \t]*(\w+)", 1)), F.lit(""))
    title = F.coalesce(h1(body(F.col("text"))), F.try_element_at(meta, F.lit("name")), F.regexp_replace("name", r"\.[^.]*$", ""))
    return files.where(F.lower(kind) == "invariant").select("name", title.alias("title")).orderBy("name")


def changed_files(files: DataFrame, watermark: DataFrame) -> DataFrame:
    """Files (path, mtime) newer than the watermark, or as new and not among those seen.

    A watermark is rows (mtime, path): the files that had the newest time, or one row with a null
    path where only the time is known. Without rows every file is new.
    """
    newest = watermark.agg(F.max("mtime").alias("_m"))
    rows = files.crossJoin(newest).where(F.col("_m").isNull() | (F.col("mtime") >= F.col("_m"))).drop("_m")
    return rows.join(watermark.where("path is not null").select("path", "mtime"), ["path", "mtime"], "left_anti").select(files.columns)


def next_watermark(files: DataFrame) -> DataFrame:
    """(mtime, path): the newest time and the files that have it, a row for each."""
    return files.join(files.agg(F.max("mtime").alias("mtime")), "mtime").select("mtime", "path")


def in_order(sources: list[tuple[str, DataFrame]], budget_s: float, clock: Callable[[], float], ingest: Callable[[str, DataFrame], None]) -> list[str]:
    """Ingest sources one after the other under one deadline; the names of those that were left for the next run."""
    began, left = clock(), []
    for name, rows in sources:
        if clock() - began >= budget_s:
            left.append(name)
        else:
            ingest(name, rows)
    return left


def read_failures(listed: DataFrame, read: DataFrame, ts: Column) -> DataFrame:
    """A ``read_fail`` row (ts, action, path, detail) of each listed file that gave no text; its watermark must not move.

    ``read`` (path, text, error).
    """
    missing = listed.select("path").join(read.where("text is not null").select("path"), "path", "left_anti")
    why = missing.join(read.select("path", "error"), "path", "left")
    return why.select(ts.alias("ts"), F.lit("read_fail").alias("action"), "path", F.substring(F.coalesce("error", F.lit("not read")), 1, 500).alias("detail"))


def replace_by_file(stored: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """Stored chunks less those of files that were read again, and the fresh ones."""
    return stored.join(fresh.select(path).distinct(), path, "left_anti").unionByName(fresh, allowMissingColumns=True)


def to_chunks(rows: DataFrame, source: str, weight: Column, role: Column | None = None) -> DataFrame:
    """Rows with ``text`` as chunks with a content id; all sources union by name."""
    from memspark.functions.text import content_id

    return rows.withColumn("id", content_id(F.col("text"))).withColumn("source", F.lit(source)).withColumn("signal_weight", weight).withColumn("role", role if role is not None else F.lit(None).cast("string"))
