"""Health checks: one row (name, ok, detail) for each, from aggregates over state and telemetry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _row(name: str, frame: DataFrame, ok: Column, detail: Column, keys: list[str] = ()) -> DataFrame:
    return frame.select(*keys, F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))


def seconds_since(ts: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(ts)


def watermark_age(meta: DataFrame, now: Column, days: float = 3) -> DataFrame:
    """The newest mtime among JSON watermarks (key ``incr:*``); bare offsets don't count."""
    newest = meta.where(F.col("key").startswith("incr:")).agg(F.max(F.try_to_number(F.get_json_object("value", "$.mtime"), F.lit("99999999999999.999")).cast("double")).alias("m"))
    age = F.unix_timestamp(now) - F.col("m")
    return _row("watermark_age", newest, age <= days * 86400, F.coalesce(F.format_string("%.1f days", age / 86400), F.lit("no watermark")))


def vector_coverage(chunks: DataFrame, vectors: DataFrame, least: float = 0.99) -> DataFrame:
    has = chunks.select("id").join(vectors.select(F.col("chunk_id").alias("id"), F.lit(1).alias("v")).distinct(), "id", "left").agg(F.count("*").alias("n"), F.count("v").alias("k"))
    ratio = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(1.0)
    return _row("vector_coverage", has, ratio >= least, F.format_string("%d of %d", "k", "n"))


def pending_queue(outcomes: DataFrame, most: int = 40) -> DataFrame:
    n = outcomes.agg(F.count_if(F.col("state") == "pending").alias("n"))
    return _row("pending_queue", n, F.col("n") <= most, F.format_string("%d pending", "n"))


def stale_lineage(threads: DataFrame) -> DataFrame:
    n = threads.agg(F.count_if(F.coalesce("lineage_cache_key", F.lit("")) != F.coalesce("last_updated", F.lit(""))).alias("n"))
    return _row("stale_lineage", n, F.col("n") == 0, F.format_string("%d stale", "n"))


def heartbeats(latest: DataFrame, now: DataFrame, per_turn: list[str], start: str, end: str, captures: list[str], by: str | None = None, max_age_s: int = 172800, grace_s: int = 600, window_s: int = 3600) -> DataFrame:
    """Consistency of hooks' heartbeats, one row (for each value of ``by``): (name, ok, detail, notes).

    ``latest`` (by, hook, last_ok, newest_success), ``now`` one row (now). Red are: a latest row with
    an error, for any hook; a per-turn hook without rows, or whose success is older than max_age_s;
    a start that lacks although a session ended after it (beyond the grace) and turns older than
    max_age_s went on after that end, unless the end is within the grace (pending); a capture hook
    that an end didn't bring within the window, or an end that the newest capture didn't, unless the
    event itself is within the window (pending). An old start without such evidence is a long
    session, and hooks that never fired at a boundary are no fault.
    """
    hooks = [*per_turn, start, end, *captures]
    flags = [F.max(F.when(F.col("hook") == h, F.col("last_ok").cast("int"))).alias(f"ok{i}") for i, h in enumerate(hooks)]
    times = [F.max(F.when(F.col("hook") == h, F.unix_timestamp("newest_success"))).alias(f"t{i}") for i, h in enumerate(hooks)]
    one = (latest.groupBy(by) if by else latest).agg(*flags, *times).crossJoin(now.select(F.unix_timestamp("now").alias("now")))
    place = {h: i for i, h in enumerate(hooks)}
    ok, t, at = (lambda h: F.col(f"ok{place[h]}")), (lambda h: F.col(f"t{place[h]}")), F.col("now")
    never = F.lit(-(10**12))
    problems, notes = [], []
    for h in per_turn:
        old = at - t(h) > max_age_s
        problems.append(F.when(ok(h).isNull(), f"{h}:no-rows").when(ok(h) != 1, f"{h}:latest-errored").when(t(h).isNull(), f"{h}:bad-ts").when(old, f"{h}:stale"))
    turn = F.greatest(*(t(h) for h in per_turn)) if len(per_turn) > 1 else t(per_turn[0])
    began = F.coalesce(t(start), never)
    lacks = F.coalesce((turn - began > max_age_s) & (t(end) - began > grace_s) & (turn > t(end)), F.lit(False))
    errored = F.coalesce(ok(start) != 1, F.lit(False))
    recent = at - t(end) <= grace_s
    problems.append(F.when(errored, f"{start}:latest-errored").when(lacks & ~recent, f"{start}:boundary-cycle-without-start"))
    notes.append(F.when(errored, None).when(lacks & recent, f"{start}:pending").when(~lacks & (turn - t(start) > max_age_s), "long-lived session").when(~lacks & t(start).isNull(), f"{start}:none-yet"))
    for h in captures:
        missed = F.coalesce(t(end) - F.coalesce(t(h), never) > window_s, F.lit(False))
        bad = F.coalesce(ok(h) != 1, F.lit(False))
        problems.append(F.when(bad, f"{h}:latest-errored").when(missed & (at - t(end) > window_s), f"{h}:missed-boundary"))
        notes.append(F.when(~bad & missed & (at - t(end) <= window_s), f"{h}:pending"))
    last = F.greatest(*(t(h) for h in captures)) if len(captures) > 1 else t(captures[0])
    missed = F.coalesce(last - F.coalesce(t(end), never) > window_s, F.lit(False))
    bad = F.coalesce(ok(end) != 1, F.lit(False))
    problems.append(F.when(bad, f"{end}:latest-errored").when(missed & (at - last > window_s), f"{end}:missed-boundary"))
    notes.append(F.when(~bad & missed & (at - last <= window_s), f"{end}:pending").when(t(end).isNull() & last.isNull(), "no session boundary observed yet"))
    out = one.withColumn("problems", F.array_compact(F.array(*problems))).withColumn("notes", F.array_join(F.array_compact(F.array(*notes)), "; "))
    detail = F.when(F.size("problems") == 0, f"all {len(hooks)} hooks consistent").otherwise(F.array_join("problems", ", "))
    return out.select(*([by] if by else []), F.lit("heartbeats").alias("name"), (F.size("problems") == 0).alias("ok"), detail.alias("detail"), "notes")


def module_states(files: DataFrame, stamp: DataFrame, now: Column, days: float = 14) -> DataFrame:
    """State files (path) and the generator's stamp (text: JSON with generated_at): red without either, or when it is old."""
    n = files.agg(F.count("*").alias("n"))
    made = stamp.agg(F.max(F.unix_timestamp(F.try_to_timestamp(F.get_json_object("text", "$.generated_at")))).alias("made"))
    age = (F.unix_timestamp(now) - F.col("made")) / 86400
    why = F.when(F.col("n") == 0, "no state files").when(F.col("made").isNull(), "no readable stamp").otherwise(F.format_string("verified %.1f days ago", age))
    return _row("module_states", n.crossJoin(made), (F.col("n") > 0) & (age <= days), why)


def corpus_age(files: DataFrame, now: Column, wired: bool, days: float = 21) -> DataFrame:
    """The newest file (mtime) of an optional corpus; green while it isn't wired, red if it is and lacks files."""
    newest = files.agg(F.max("mtime").alias("m"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("m")) / 86400
    if not wired:
        return _row("corpus_age", newest, F.lit(True), F.lit("not wired"))
    return _row("corpus_age", newest, age <= days, F.coalesce(F.format_string("newest file %.1f days old", age), F.lit("no files")))


def index_health(index: DataFrame, files: DataFrame, now: Column, header: str, most_lines: int = 280, most_bytes: int = 90_000, days: float = 7, by: str | None = None) -> DataFrame:
    """The index file (text) by its lines and bytes, and the age of the first file (name, mtime) linked after the header.

    With ``by`` each of its keys has an index and files of its own, and a row.

    ``header`` is the pattern of the line below which the anchor stands. An index that is missing,
    an anchor that is missing, unknown or old, and too many lines or bytes are red.
    """
    text = F.col("text")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    below = F.regexp_extract(text, rf"(?ms)^{header}.*", 0)
    link = F.nullif(F.regexp_extract(below, r"\]\(([^)\s]+\.md)\)", 1), F.lit(""))
    keys = [by] if by else []
    one = index.select(*keys, lines.alias("n"), F.octet_length(text).alias("b"), F.element_at(F.split(link, "/"), -1).alias("anchor"))
    one = one.join(files.select(*keys, F.col("name").alias("anchor"), "mtime"), [*keys, "anchor"], "left").groupBy(*keys).agg(F.max("n").alias("n"), F.max("b").alias("b"), F.max("anchor").alias("anchor"), F.max("mtime").alias("m"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("m")) / 86400
    problems = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("n") > most_lines, "too many lines"), F.when(F.col("b") > most_bytes, "too many bytes"),
        F.when(F.col("n").isNotNull() & F.col("anchor").isNull(), "no anchor").when(F.col("anchor").isNotNull() & F.col("m").isNull(), "anchor missing").when(age > days, "anchor old"),
    ))
    return _row("index_health", one, F.size(problems) == 0, keys=keys, detail=F.when(F.size(problems) == 0, F.format_string("%d lines, %d bytes", "n", "b")).otherwise(F.array_join(problems, ", ")))


def novelty(renders: DataFrame, by: str | None = None, others: int = 2, disarmed: int = 3, every: DataFrame | None = None) -> DataFrame:
    """(by, name, ok, detail): whether the newest render (id, session_id, hash, corpus_sig) still follows the corpus.

    Red without any render (of the table, or of a key of ``every``) and without a hash of the newest
    one. Red if the latest observations of ``others`` other sessions have its hash while the corpus
    has moved since the older of them (an empty signature says nothing of that), or if none of the
    last ``disarmed`` observations before a newest one without a session has a session.
    """
    key = by or "_all"
    rows = renders if by else renders.withColumn(key, F.lit(0))
    rows = rows.withColumns({"session_id": F.nullif(F.col("session_id").cast("string"), F.lit("")), "corpus_sig": F.nullif(F.col("corpus_sig").cast("string"), F.lit(""))})
    newest = rows.groupBy(key).agg(F.max_by(F.struct("id", "session_id", "hash", "corpus_sig"), "id").alias("now"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))
    before = rows.withColumn("place", place).where(F.col("place") <= disarmed + 1).where("place > 1").groupBy(key).agg(F.count("*").alias("recent"), F.count("session_id").alias("named"))
    each = rows.where("session_id is not null").groupBy(key, "session_id").agg(F.max_by(F.struct("hash", "corpus_sig"), "id").alias("r"), F.max("id").alias("id"))
    each = each.join(newest.select(key, F.col("now.session_id").alias("current")), key).where("current is not null and session_id <> current")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))
    last = each.withColumn("place", nth).where(F.col("place") <= others).groupBy(key).agg(F.count("*").alias("k"), F.min("r.hash").alias("low"), F.max("r.hash").alias("high"), F.min_by("r.corpus_sig", "id").alias("sig"))
    keys = renders.sparkSession.range(1).select(F.lit(0).alias(key)) if not by else every.select(key).distinct() if every is not None else newest.select(key)
    one = keys.join(newest, key, "left").join(before, key, "left").join(last, key, "left")
    never = F.col("n").isNull() | (F.coalesce("now.hash", F.lit("")) == "")
    unknown = F.col("now.session_id").isNull()
    off = unknown & (F.coalesce("recent", F.lit(0)) >= disarmed) & (F.coalesce("named", F.lit(0)) == 0)
    same = F.coalesce((F.col("k") >= others) & (F.col("low") == F.col("high")) & (F.col("low") == F.col("now.hash")), F.lit(False))
    frozen = same & F.col("sig").isNotNull() & ~F.col("sig").eqNullSafe(F.col("now.corpus_sig"))
    why = F.when(never, "no render recorded").when(F.col("n") == 1, "first observation").when(off, "guard disarmed").when(unknown, "session unknown").when(F.coalesce("k", F.lit(0)) < others, "too few sessions").when(frozen, "render frozen").when(same, "corpus idle").otherwise("render follows corpus")
    return one.select(*([by] if by else []), F.lit("novelty").alias("name"), (~never & ((F.col("n") == 1) | ~off & ~frozen)).alias("ok"), why.alias("detail"))


def health_line(beats: DataFrame, now: Column, hooks: DataFrame, stale_days: float = 2) -> DataFrame:
    """(hook, state, age_days, detail) of each of ``hooks``: what a session is told of its latest run in ``beats`` (id, hook, ts, ok, detail).

    ``none`` if no run is recorded, ``stale`` if the latest is older than ``stale_days``, ``errored`` if it
    failed, else ``ok``. A time that can't be read has no age and isn't stale.
    """
    last = beats.groupBy("hook").agg(F.max_by(F.struct("ts", "ok", "detail"), "id").alias("run"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(F.col("run.ts").cast("string")))) / 86400
    state = F.when(F.col("run").isNull(), "none").when(age > stale_days, "stale").when(~F.coalesce("run.ok", F.lit(False)), "errored").otherwise("ok")
    return hooks.select("hook").distinct().join(last, "hook", "left").select("hook", state.alias("state"), age.alias("age_days"), F.col("run.detail").alias("detail"))


def stable_hash(block: Column) -> Column:
    """SHA-256 of a rendered block less its health lines, whose times change with every run."""
    lines = F.split(block, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)  # a line end ends a line
    return F.sha2(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^memory-health\b")), "\n"), 256)


def repeated_renders(renders: DataFrame) -> DataFrame:
    """Each render with a flag: same hash as the one before, another session, a moved corpus."""
    w = Window.orderBy("id").partitionBy("project")
    before = [F.lag(c).over(w) for c in ("hash", "session_id", "corpus_sig")]
    return renders.withColumn("flag", F.coalesce((before[0] == F.col("hash")) & (before[1] != F.col("session_id")) & (before[2] != F.col("corpus_sig")), F.lit(False)))


def deprecated_tokens(texts: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    hits = [F.max(F.when(F.contains(F.col(column), F.lit(t)), F.lit(t))) for t in tokens]
    found = F.array_compact(F.array(*hits))
    return texts.agg(found.alias("f")).select(F.lit("deprecated_tokens").alias("name"), (F.size("f") == 0).alias("ok"), F.array_join("f", ", ").alias("detail"))


def gate(checks: list[DataFrame]) -> DataFrame:
    """All checks, with the number of red ones on each row."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.crossJoin(rows.agg(F.count_if(~F.col("ok")).alias("n_red")))


def run_gate(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The gate with each check run by itself: one that fails is a red row that says why, not a failed gate.

    A check is one row, so a row for each check is all that the driver holds.
    """
    rows = []
    for name, check in checks.items():
        try:
            rows += [(r["name"], r["ok"], r["detail"]) for r in check().select("name", "ok", "detail").collect()]
        except Exception as e:  # whatever a check dies of is its result
            rows.append((name, False, f"check failed: {type(e).__name__}"))
    return gate([spark.createDataFrame(rows, "name string, ok boolean, detail string")])


def budget_report(index: DataFrame, sections: DataFrame, links: DataFrame, orphans: DataFrame, most_lines: int = 280, most_bytes: int = 90_000, largest: int = 5, listed: int = 20) -> DataFrame:
    """(part, place, line): the index's size (n_lines, n_bytes) against its budget, then its largest sections if it is over.

    After that the links (link, n) that occur more than once, and the files (name) that no link
    names: how many, the first ``listed``, and how many more. All lists are limited before they are ranked.
    """
    over = (F.col("n_lines") > most_lines) | (F.col("n_bytes") > most_bytes)
    head = index.select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.format_string(f"budget: %d lines (max {most_lines}), %d bytes (max {most_bytes})%s", "n_lines", "n_bytes", F.when(over, " OVER").otherwise(" OK")).alias("line"))
    top = sections.orderBy(F.desc("n_lines"), "title").limit(largest).crossJoin(index.where(over).select(F.lit(1).alias("_o")))
    top = top.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(F.desc("n_lines"), "title")).alias("place"), F.format_string("%d lines  %s", "n_lines", F.substring("title", 1, 90)).alias("line"))
    twice = links.where("n > 1").orderBy(F.desc("n"), "link").limit(listed)
    twice = twice.select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy(F.desc("n"), "link")).alias("place"), F.format_string("%s (x%d)", "link", "n").alias("line"))
    total = orphans.agg(F.count("*").alias("n"))
    lone = total.select(F.lit(3).alias("part"), F.lit(0).alias("place"), F.format_string("not linked: %d files", "n").alias("line"))
    names = orphans.orderBy("name").limit(listed).select(F.lit(3).alias("part"), F.row_number().over(Window.orderBy("name")).alias("place"), F.col("name").alias("line"))
    more = total.where(F.col("n") > listed).select(F.lit(3).alias("part"), F.lit(listed + 1).alias("place"), F.format_string("and %d more", F.col("n") - listed).alias("line"))
    return reduce(DataFrame.unionByName, [head, top, twice, lone, names, more])


def self_heartbeat(gated: DataFrame, ts: Column) -> DataFrame:
    """The gate's own heartbeat row (ts, hook, ok, detail): it ran, and what it found red."""
    red = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ", ")
    return gated.agg(red.alias("red")).select(ts.alias("ts"), F.lit("health_gate").alias("hook"), F.lit(1).alias("ok"), F.when(F.col("red") != "", F.substring(F.concat(F.lit("red: "), F.col("red")), 1, 500)).alias("detail"))


def duplicate_links(lines: DataFrame, column: str) -> DataFrame:
    """Markdown links that occur more than once: (link, n), most frequent first."""
    each = lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\]\(([^)]+)\)"))).alias("link"))
    return each.groupBy("link").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "link")
