"""Aggregates over event telemetry: weekly summary, percentiles, topics, status, heartbeats, damping."""

from __future__ import annotations

from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.session import materialize


def grouped_nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], ranges: int = 64) -> DataFrame:
    """(keys, n, a column for each share): the value at place floor(n * share), 0-based, at most the last, of the sorted non-zero values.

    Exact for groups of any size: values are counted, a group's counts are cut into ranges at
    approximate quantiles, and only the range that holds a place is sorted. The quantiles are written:
    computed again they may differ, and places would be looked for in other ranges than were counted.
    """
    counts = rows.where((F.col(value) != 0) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("cuts"), F.sum("n").alias("total"))
    cuts = materialize(cuts, "cuts")
    placed = counts.join(cuts, keys).select(*keys, value, "n", "total", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("range"))
    per = placed.groupBy(*keys, "range").agg(F.sum("n").alias("m"), F.max("total").alias("total"))
    per = per.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys).orderBy("range")))  # ``ranges`` rows for each group at most
    place = [F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("total") * F.lit(s)), F.col("total") - 1).alias("at")) for name, s in shares.items()]
    wanted = per.select(*keys, "range", "total", (F.col("upto") - F.col("m")).alias("before"), "upto", F.explode(F.array(*place)).alias("p")).where((F.col("p.at") >= F.col("before")) & (F.col("p.at") < F.col("upto")))
    inner = placed.drop("total").join(wanted, [*keys, "range"])
    run = F.sum("n").over(Window.partitionBy(*keys, "range", "p.name").orderBy(value))
    found = inner.withColumn("run", run + F.col("before")).where(F.col("run") > F.col("p.at"))
    return found.groupBy(*keys).agg(F.max("total").alias("n"), *(F.min(F.when(F.col("p.name") == name, F.col(value))).alias(name) for name in shares))


def weekly_summary(rows: DataFrame, now: Column, flags: dict[str, Column], days: int = 7, ts: str = "ts") -> DataFrame:
    """One row: invocations of the last days and how many have each flag."""
    recent = rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))
    return recent.agg(F.count("*").alias("invocations"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def top_topics(rows: DataFrame, topics: str, order: str, k: int = 10) -> DataFrame:
    """(topic, n) of the k most frequent strings of JSON arrays; ties to the topic seen first; bad JSON is skipped."""
    each = rows.select(order, F.explode(F.from_json(F.col(topics), "array<string>", {"mode": "PERMISSIVE"})).alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen", "topic").limit(k)


def status_histogram(rows: DataFrame, component: str, status: str, values: list[str], bad: list[str]) -> DataFrame:
    """A row for each component with a count of each status, and whether the bad ones occur."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    return rows.groupBy(component).agg(*counts, F.bool_or(F.col(status).isin(bad)).alias("warn"))


def latest_heartbeat(rows: DataFrame, hook: str, ok: Column, ts: str, order: str) -> DataFrame:
    """(hook, last_ok, last_ts, newest_success) of each hook: its latest flag and its newest success."""
    flag = rows.withColumn("_ok", ok)
    return flag.groupBy(hook).agg(F.max_by("_ok", order).alias("last_ok"), F.max_by(ts, order).alias("last_ts"), F.max(F.when(F.col("_ok"), F.col(ts))).alias("newest_success"))


def damped(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` deliveries of each key; rows with a null first key have no cap and no number."""
    known = rows.where(F.col(keys[0]).isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    counted = known.withColumn("delivery", place).where(F.col("delivery") <= cap)
    return counted.unionByName(rows.where(F.col(keys[0]).isNull()).withColumn("delivery", F.lit(None).cast("int")))


def first_novel(rows: DataFrame, delivered: DataFrame, session: str, item: str, order: list[str]) -> DataFrame:
    """The first row of each session whose item wasn't delivered in it before."""
    fresh = rows.join(delivered.select(session, item).distinct(), [session, item], "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where("_r = 1").drop("_r")


def recent_sessions(rows: DataFrame, session: str, order: str, most: int = 2) -> DataFrame:
    """The latest observation of each session, of the ``most`` latest sessions."""
    last = rows.where(F.col(session).isNotNull()).groupBy(session).agg(F.max(order).alias(order))
    return last.orderBy(F.desc(order), session).limit(most)


def corpus_signature(rows: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 over the sorted hashes of key=value pairs, in two steps, and their count.

    Pairs are hashed, dealt into 4,096 buckets by hash and hashed again bucket by bucket, so no row
    holds all pairs; equal sets of pairs have equal signatures in any order.
    """
    each = rows.select(F.sha2(F.concat_ws("=", key, value), 256).alias("h"))
    buckets = each.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("s"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), "")
    return buckets.agg(F.sha2(F.concat_ws("\n", whole, F.coalesce(F.sum("n"), F.lit(0)).cast("string")), 256).alias("signature"))


def invocation_rows(events: DataFrame, ts: Column, most: int = 200) -> DataFrame:
    """One telemetry row for each prompt event: hash and head of the prompt, lists and maps as JSON."""
    lists = [F.to_json(F.col(c)).alias(f"{c}_json") for c, t in events.dtypes if t.startswith(("array", "map"))]
    plain = [c for c, t in events.dtypes if not t.startswith(("array", "map")) and c != "prompt"]
    return events.select(ts.alias("ts"), *plain, F.sha2("prompt", 256).alias("prompt_hash"), F.substring("prompt", 1, most).alias("prompt_truncated"), *lists)


def heartbeat_rows(runs: DataFrame, ts: Column, hook: str = "hook", error: str = "error", most: int = 500) -> DataFrame:
    """(ts, hook, ok, detail) of each run of a hook: ok where no error was raised."""
    return runs.select(ts.alias("ts"), F.col(hook).alias("hook"), F.col(error).isNull().cast("int").alias("ok"), F.substring(error, 1, most).alias("detail"))


def component_rows(probes: DataFrame, ts: Column, slow_ms: int = 2000) -> DataFrame:
    """(ts, component, status, latency_ms, detail) of probes (component, latency_ms, error): FAIL, WARN if slow, else OK."""
    status = F.when(F.col("error").isNotNull(), "FAIL").when(F.col("latency_ms") > slow_ms, "WARN").otherwise("OK")
    return probes.select(ts.alias("ts"), "component", status.alias("status"), "latency_ms", F.substring("error", 1, 500).alias("detail"))


def append(rows: DataFrame, path: str) -> None:
    """Rows are added to a telemetry table; its files are never rewritten."""
    rows.write.mode("append").parquet(path)


def report_lines(summary: DataFrame, topics: DataFrame, statuses: DataFrame) -> DataFrame:
    """(section, place, line): a weekly report as ordered Markdown lines, from its small aggregates."""
    names = summary.columns
    head = summary.select(F.posexplode(F.array(*(F.concat(F.lit(f"- {n}: "), F.col(n).cast("string")) for n in names))).alias("place", "line")).select(F.lit(0).alias("section"), "place", "line")
    second = topics.select(F.lit(1).alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "first_seen", "topic")).alias("place"), F.concat(F.lit("- "), "topic", F.lit(": "), F.col("n").cast("string")).alias("line"))
    third = statuses.select(F.lit(2).alias("section"), F.row_number().over(Window.orderBy("component")).alias("place"), F.concat(F.lit("- "), F.col("component").cast("string"), F.when(F.col("warn"), " WARN").otherwise("")).alias("line"))
    return head.unionByName(second).unionByName(third)


def weekly_report(calls: DataFrame, beats: DataFrame, degradations: DataFrame | None, now: Column, flags: dict[str, Column], title: str, days: int = 7, k: int = 10) -> DataFrame:
    """(section, place, line): the Markdown report of the last days, as ordered lines.

    ``calls`` (id, ts, latency_ms, topics as JSON, and what ``flags``, label: condition, read), ``beats``
    (id, ts, component, status), ``degradations`` (id, ts, reason; None where none are recorded at all).
    Sections without rows are left out. Every line comes from an aggregate of bounded size but the
    components', of which a row each is kept.
    """

    def lately(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))

    def lines(rows: DataFrame, section: int, place: Column | int, line: Column | str) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), (F.lit(place) if isinstance(place, int) else place).cast("int").alias("place"), (F.lit(line) if isinstance(line, str) else line).alias("line"))

    one = calls.sparkSession.range(1)
    recent, own = lately(calls), lately(beats)
    head = lines(one, 0, 0, f"# {title}").unionByName(lines(one, 0, 1, F.concat(F.lit(f"Window: last {days} days  |  Generated: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))))
    counts = recent.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"f{i}") for i, c in enumerate(flags.values())))
    told = [("Wrapper invocations", "n"), *((label, f"f{i}") for i, label in enumerate(flags))]
    each = counts.select(F.posexplode(F.array(*(F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")) for label, c in told))).alias("place", "line"))
    wrapper = lines(one, 1, 0, "## Wrapper").unionByName(lines(each, 1, F.col("place") + 1, F.col("line")))
    ranks = grouped_nearest_rank(recent.withColumn("_all", F.lit(0)), ["_all"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    wrapper = wrapper.unionByName(lines(ranks, 1, len(told) + 1, F.format_string("- Retrieval latency p50/p95: %s / %s ms", F.col("p50").cast("string"), F.col("p95").cast("string"))))
    parts = [head, wrapper]
    if degradations is not None:
        lost = lately(degradations).agg(F.count("*").alias("n"), F.max_by(F.struct("ts", "reason"), "id").alias("last"))
        latest = F.concat(F.lit("- WARN: vector leg degraded in window; latest "), F.date_format("last.ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(": "), F.coalesce("last.reason", F.lit("")))
        parts += [lines(one, 2, 0, "## Embed vector leg"), lines(lost, 2, 1, F.format_string("- Degradation events (search fell back to BM25-only): %d", "n")), lines(lost.where("n > 0"), 2, 2, latest)]
    topics = top_topics(recent, "topics", "id", k).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen", "topic")))
    parts += [lines(topics.where("place = 1"), 3, 0, "## Top topics triggering warnings"), lines(topics, 3, F.col("place"), F.format_string("- %s: %d", "topic", "n"))]
    health = own.groupBy("component").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in ("alive", "degraded", "dead")), F.min("id").alias("first_seen"))
    health = health.withColumn("place", F.row_number().over(Window.orderBy("first_seen", "component")))
    warn = F.when((F.col("dead") > 0) | (F.col("degraded") > 0), "  WARN: degraded/dead samples in window").otherwise("")
    parts += [lines(health.where("place = 1"), 4, 0, "## Component health (heartbeat samples)"), lines(health, 4, F.col("place"), F.concat(F.format_string("- %s: alive=%d/%d degraded=%d dead=%d", "component", "alive", "n", "degraded", "dead"), warn))]
    nothing = counts.select("n").crossJoin(own.agg(F.count("*").alias("m"))).where("n = 0 and m = 0")
    parts.append(lines(nothing, 5, 0, "(no telemetry rows in the window)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_weekly(report: DataFrame, folder: str, now: datetime) -> str:
    """Write a report (section, place, line) as ``{year}-{week}.md`` below a shared folder (a URI); its path.

    Weeks begin on Mondays; a later report of the same week takes the file's place. A report is a few lines and a line for each component.
    """
    body, last = [], None
    for r in report.orderBy("section", "place").collect():
        if last is not None and r["section"] != last:
            body.append("")
        last = r["section"]
        body.append(r["line"])
    fs, path = pafs.FileSystem.from_uri(folder)
    name = f"{now:%Y-%W}.md"
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}.new") as f:
        f.write("\n".join(body).encode())
    fs.move(f"{path}/{name}.new", f"{path}/{name}")
    return f"{folder}/{name}"
