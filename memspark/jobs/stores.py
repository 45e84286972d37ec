"""Registered queries of stores that files feed: incremental runs, backfills from a project's records, report files, re-grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memspark.functions import classify, lexicon, text as tx
from memspark.jobs.catalog import _docs, _any, CORRECTIONS, DECISIONS, INVESTIGATIONS, ROSTER, query
from memspark.jobs.more import _session_files
from memspark.operators import capture, ingest, telemetry
from memspark.session import table
from memspark.streaming import mining


def _flat(text: Column) -> Column:
    """One line without heading marks."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("#"), F.lit("")), r"\s+", " "))


_FLAT = "trim(regexp_replace(replace(text, '#', ''), '\\s+', ' ', 'g'))"


@query(f"""WITH m AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS section, rtrim('## ' || conv_id || '/' || turn || ' ' || role || chr(10) || CASE WHEN conv_id % 7 = 0 AND conv_id % 3 > 0 THEN 'now ' ELSE '' END || {_FLAT}, ' ' || chr(10)) AS body FROM conversations)
SELECT CASE WHEN conv % 5 = 0 THEN 'memory' ELSE 'doc' END AS source, conv, section, (f / 6000)::INT AS part, md5(body[f + 1:f + 6000]) AS content, CASE WHEN conv % 5 = 0 THEN 40 ELSE 20 END AS signal_weight, CASE WHEN conv % 3 = 0 OR conv % 7 = 0 THEN 2 ELSE 1 END AS run
FROM (SELECT *, unnest(range(0, length(body), 6000)) AS f FROM m)""")
def l2_incremental_run(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as Markdown files of two sources, ingested twice: first those that there are, then those that are new or written anew."""
    root = mining.state_folder(spark, "incremental")
    c = table(spark, sf, "conversations")
    folders = [("memory", F.col("conv") % 5 == 0), ("docs", F.col("conv") % 5 > 0)]

    def write(rows: DataFrame, mark: str) -> None:
        line = F.concat(F.lit("## "), F.col("conv"), F.lit("/"), F.col("turn"), F.lit(" "), F.col("role"), F.lit("\n" + mark), _flat(F.col("text")))
        for folder, own in folders:
            mining.write_logs(rows.where(own).select("conv", "turn", line.alias("line")), "conv", ["turn"], "line", f"{root}/{folder}", ".md")

    rows = c.withColumnRenamed("conv_id", "conv")
    sources = [ingest.Files("memory", f"{root}/memory", lambda p: F.lit(40)), ingest.Files("doc", f"{root}/docs")]
    write(rows.where("conv % 3 > 0"), "")
    ingest.run(spark, f"{root}/store", sources, ROSTER, budget_s=3600)
    between = ingest.manifest(spark, f"{root}/store").agg(F.max("wave")).first()[0]
    write(rows.where("conv % 3 = 0"), "")
    write(rows.where("conv % 3 > 0 and conv % 7 = 0"), "now ")
    ingest.run(spark, f"{root}/store", sources, ROSTER, budget_s=3600)
    conv = F.regexp_extract("file_path", r"(\d+)\.md$", 1).cast("bigint")
    run = F.when(F.col("wave") <= (between or 0), 1).otherwise(2)
    return ingest.stored(spark, f"{root}/store").select("source", conv.alias("conv"), "section", "part", F.md5("content").alias("content"), "signal_weight", run.alias("run"))


@query(f"""WITH s AS (SELECT 'claude_code' AS source, 0 AS o, text AS content, CASE WHEN role = 'user' THEN CASE WHEN {_any('text', CORRECTIONS)} THEN 100 WHEN {_any('text', DECISIONS)} THEN 50 WHEN {_any('text', INVESTIGATIONS)} THEN 30 ELSE 10 END WHEN role = 'assistant' THEN CASE WHEN {_any('text', DECISIONS)} THEN 20 ELSE 0 END ELSE 20 END AS signal_weight, role = 'user' AND {_any('text', CORRECTIONS)} AS is_correction, conv_id || '/' || turn AS pos FROM conversations WHERE trim(text) <> ''),
b AS (SELECT rtrim('## Document' || chr(10) || {_FLAT}, ' ' || chr(10)) AS body FROM documents),
d AS (SELECT 'doc', 1, body[f + 1:f + 6000], 20, false, '' FROM (SELECT body, unnest(range(0, length(body), 6000)) AS f FROM b)),
e AS (SELECT 'experiment_summary', 3, 'Experiment experiments: final_tick=' || s_suppkey || ' n_completed_tasks=' || s_nationkey || ' coverage_total=? coverage_classes=3 ddx_intents_total=?', 30, false, '' FROM supplier),
g AS (SELECT 'git', 4, o_orderpriority || ' of ' || o_orderkey || chr(10) || chr(10) || 'by ' || o_orderstatus, 15, false, '' FROM orders),
u AS (SELECT * FROM s WHERE signal_weight > 0 UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM g),
k AS (SELECT *, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS id FROM u)
SELECT id, source, signal_weight, is_correction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, pos) AS r FROM k) WHERE r = 1""")
def a9_project_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A project's records as files of each kind, read by the readers and stored once: sessions, ten documents in a file, progress files, a git log."""
    root = mining.state_folder(spark, "project")
    d = table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("book"), "doc_id", F.concat(F.lit("## Document\n"), _flat(F.col("text"))).alias("line"))
    mining.write_logs(d, "book", ["doc_id"], "line", f"{root}/docs", ".md")
    record = F.to_json(F.struct(F.col("s_suppkey").alias("tick"), F.col("s_nationkey").alias("n_completed_tasks"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("coverage_classes")))
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit('{"tick": 0}\n'), record, F.lit("\n{broken")).alias("line"))
    mining.write_logs(s, "s_suppkey", ["s_suppkey"], "line", f"{root}/experiments")
    o = table(spark, sf, "orders")
    commit = F.concat_ws("\t", F.md5(F.col("o_orderkey").cast("string")), "o_orderstatus", F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.concat(F.col("o_orderpriority"), F.lit(" of "), F.col("o_orderkey").cast("string"), F.lit("\nby "), F.col("o_orderstatus"), F.lit("\n\x1e")))
    o.select(commit.alias("value")).write.text(f"{root}/git")
    project = ingest.Project(sessions=_session_files(spark, sf), docs=f"{root}/docs", experiments=f"{root}/experiments", git=f"{root}/git")
    chunks, _ = ingest.backfill(spark, project, ROSTER, (), CORRECTIONS, DECISIONS, INVESTIGATIONS)
    return chunks.select("id", "source", "signal_weight", "is_correction")


@query("""WITH e AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY), n AS (SELECT max(ts) AS now FROM events),
v AS (SELECT list_sort(list(floor(value)::INT)) AS l FROM e WHERE floor(value) <> 0),
x AS (SELECT event_id, ts, props FROM e WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 1),
t AS (SELECT string_agg('- ' || event_type || ': ' || n, chr(10) ORDER BY n DESC, f, event_type) AS s FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY event_type ORDER BY n DESC, f LIMIT 10)),
h AS (SELECT string_agg('- ' || event_type || ': alive=' || (n - g - d) || '/' || n || ' degraded=' || g || ' dead=' || d || CASE WHEN g + d > 0 THEN '  WARN: degraded/dead samples in window' ELSE '' END, chr(10) ORDER BY f) AS s FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 300 AND value <= 400) AS g, count(*) FILTER (WHERE value > 400) AS d, min(event_id) AS f FROM e GROUP BY event_type))
SELECT strftime(now, '%Y-%W') || '.md' AS name, '# weekly summary' || chr(10) || 'Window: last 7 days  |  Generated: ' || strftime(now, '%Y-%m-%dT%H:%M:%S') || chr(10) || chr(10) || '## Wrapper' || chr(10)
|| '- Wrapper invocations: ' || (SELECT count(*) FROM e) || chr(10) || '- Build-intent fires: ' || (SELECT count(*) FROM e WHERE event_type = 'click') || chr(10) || '- Stale-claim warnings emitted: ' || (SELECT count(*) FROM e WHERE event_type = 'view') || chr(10)
|| '- Retrieval latency p50/p95: ' || l[len(l) // 2 + 1] || ' / ' || l[least(len(l) - 1, floor(len(l) * 0.95)::INT) + 1] || ' ms' || chr(10) || chr(10)
|| '## Embed vector leg' || chr(10) || '- Degradation events (search fell back to BM25-only): ' || (SELECT count(*) FROM e WHERE event_type = 'error') || chr(10) || '- WARN: vector leg degraded in window; latest ' || strftime(x.ts, '%Y-%m-%dT%H:%M:%S') || ': ' || x.props || chr(10) || chr(10)
|| '## Top topics triggering warnings' || chr(10) || t.s || chr(10) || chr(10) || '## Component health (heartbeat samples)' || chr(10) || h.s AS text FROM n, v, x, t, h""")
def a12_weekly_file(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly report of events, written to the week's file and read from there."""
    e = table(spark, sf, "events").withColumn("id", F.col("event_id"))
    now = e.agg(F.max("ts")).first()[0]
    calls = e.withColumns({"latency_ms": F.floor("value").cast("int"), "topics": F.to_json(F.array("event_type"))})
    status = F.when(F.col("value") > 400, "dead").when(F.col("value") > 300, "degraded").otherwise("alive")
    beats = e.select("id", "ts", F.col("event_type").alias("component"), status.alias("status"))
    lost = e.where("event_type = 'error'").select("id", "ts", F.col("props").alias("reason"))
    flags = {"Build-intent fires": F.col("event_type") == "click", "Stale-claim warnings emitted": F.col("event_type") == "view"}
    path = telemetry.write_weekly(telemetry.weekly_report(calls, beats, lost, F.lit(now), flags, "weekly summary"), mining.state_folder(spark, "reports"), now)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT DISTINCT doc_id FROM t, (VALUES ('tion'), ('ing'), ('the'), ('und'), ('que')) r(name) WHERE regexp_matches(t, '(^|[^a-z0-9])' || name || '($|[^a-z0-9])')),
c AS (SELECT d.doc_id, source, contains(text, '###') AS harness, coalesce(toxic = 1, false) AND source <> 'src0' AS cleared, n_chars % 100 = 0 AND coalesce(quality = 1, false) AND (toxic = 0 OR (toxic = 1 AND source <> 'src0')) AS low, d.doc_id % 4 > 0 AND (p.doc_id IS NOT NULL OR lang IN ('en', 'de')) AS filled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id)
SELECT source, count(*) FILTER (WHERE cleared) AS cleared, count(*) FILTER (WHERE harness AND NOT coalesce(low, false)) AS demoted, count(*) FILTER (WHERE filled) AS filled, count(*) FILTER (WHERE NOT (cleared OR filled OR (harness AND NOT coalesce(low, false)))) AS unchanged FROM c GROUP BY ROLLUP (source)""")
def j8_regrade_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What a re-grading changed, by source: modules come from the text, else from the path."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang").join(_docs(spark, sf), "id").join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    marked = F.regexp_replace("content", "###", lexicon.HARNESS_MARKERS[1][0])
    chunks = d.select("id", "lang", "source", marked.alias("content"), F.when(F.col("source") == "src0", "user").otherwise("assistant").alias("role"), (F.col("toxic") == 1).alias("is_correction"), (F.col("quality") == 0).alias("is_decision"), "signal_weight", F.when(F.col("id") % 4 == 0, "known").alias("module"))
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/x.md"))
    return capture.regrade_counts(capture.regrade(chunks, tx.detect_module(F.col("content"), ROSTER), tx.module_of_path(path, ["en", "de"], ["docs/"])))


@query("SELECT page_id FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['en', 'fr'])")
def c22_skipped_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which no part of the path is on the list of those to skip."""
    return table(spark, sf, "pages").where(~classify.path_is_skipped(F.col("url"), ["en", "fr"])).select("page_id")
