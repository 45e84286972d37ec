"""More registered queries: sources, set operations, state, health and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from memspark.functions import classify, embed, text as tx
from memspark.functions.stem import stemmed
from memspark.jobs.catalog import _ECHO, _STATE, CORRECTIONS, DECISIONS, _any, _clip, _docs, _messages, _outcomes, query
from memspark.operators import capture, health, search, telemetry
from memspark.operators.ranks import placed
from memspark.session import scratch_path, table
from memspark.sources import readers
from memspark.streaming import jobs, mining


#: A line that begins with one of these words stands for a heading.
HEADING = r"[^\S\n]*(The|Of|In) "


def _session_files(spark: SparkSession, sf: str) -> str:
    """conversations written as session JSONL, a block list for every other message; messages come by conversation and turn, as text, from file to file."""
    path = scratch_path(spark, "sessions")
    c = table(spark, sf, "conversations")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.substring("text", 1, 10).alias("text")), F.struct(F.lit("image").alias("type"), F.lit("none").alias("text")), F.struct(F.lit("text").alias("type"), F.expr("substring(text, 11)").alias("text"))))
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("c")))).otherwise(F.concat(F.lit('{"c":'), block, F.lit("}")))
    message = F.concat(F.lit('{"timestamp":"'), F.col("at"), F.lit('","message":{"role":"'), F.col("role"), F.lit('","content":'), F.expr("substring(c, 6, length(c) - 6)"), F.lit("}}"))
    told = c.withColumns({"c": content, "at": F.format_string("%d/%d", "conv_id", "turn")}).select("at", message.alias("value"))
    told.repartitionByRange("at").select("value").union(spark.range(1).select(F.lit("{bad json").alias("value"))).write.text(path)
    return path


@query("SELECT conv_id || '/' || turn AS ts, role, md5(text) AS text FROM conversations WHERE trim(text) <> ''")
def a1_session_reader(spark: SparkSession, sf: str) -> DataFrame:
    return readers.sessions(spark, _session_files(spark, sf)).select("ts", "role", F.md5("text").alias("text"))


@query("SELECT conv_id || '/' || turn AS ts, role, CASE WHEN turn % 2 = 0 THEN md5(text) ELSE md5(text[1:10] || chr(10) || 'none' || chr(10) || text[11:]) END AS text FROM conversations")
def a2_message_reader(spark: SparkSession, sf: str) -> DataFrame:
    return readers.messages(spark, _session_files(spark, sf)).where("ts is not null").select("ts", "role", F.md5("text").alias("text"))


@query(f"""WITH u AS (SELECT 'doc' AS source, text, 0 AS o, doc_id AS n, CASE WHEN n_chars % 100 >= 50 THEN 50 ELSE 20 END AS w FROM documents
UNION ALL SELECT 'session', text, 1, conv_id * 1000 + turn, CASE WHEN role = 'user' THEN CASE WHEN {_any('text', CORRECTIONS)} THEN 100 ELSE 10 END ELSE 20 END FROM conversations
UNION ALL SELECT 'prompt', text, 2, item_id, 20 FROM benchmark),
f AS (SELECT *, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY o, n) AS r FROM u)
SELECT source, w AS signal_weight, count(*) AS n FROM f WHERE r = 1 GROUP BY ALL""")
def a9_backfill(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    weight = F.when(F.col("role") == "user", F.when(tx.phrase_any(F.col("text"), CORRECTIONS), 100).otherwise(10)).otherwise(20)
    parts = [
        readers.to_chunks(table(spark, sf, "documents").select("text", F.lit(0).alias("o"), F.col("doc_id").alias("n"), "n_chars"), "doc", F.when(F.col("n_chars") % 100 >= 50, 50).otherwise(20)).drop("n_chars"),
        readers.to_chunks(c.select("text", F.lit(1).alias("o"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "role"), "session", weight, F.col("role")),
        readers.to_chunks(table(spark, sf, "benchmark").select("text", F.lit(2).alias("o"), F.col("item_id").alias("n")), "prompt", F.lit(20)),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return capture.first_by_content(every, "text", ["o", "n"]).groupBy("source", "signal_weight").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM documents")
def e1_corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS n, arg_max(user_id, event_id) FILTER (WHERE event_type = 'error') AS last_user, max(ts) FILTER (WHERE event_type = 'error') AS last_ts FROM events")
def e8_degradation(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "events").where("event_type = 'error'")
    return bad.agg(F.count("*").alias("n"), F.max_by("user_id", "event_id").alias("last_user"), F.max("ts").alias("last_ts"))


@query("SELECT max(CASE WHEN event_type <> 'view' THEN (user_id * 10)::DOUBLE END) AS newest FROM events")
def e12_watermark(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") == "view", F.col("user_id").cast("string")).otherwise(F.to_json(F.struct((F.col("user_id") * 10).alias("mtime"))))
    return table(spark, sf, "events").select(F.get_json_object(value, "$.mtime").cast("double").alias("m")).agg(F.max("m").alias("newest"))


@query("SELECT source, count(*) AS n FROM documents WHERE contains(text, '###') GROUP BY source")
def e14_demoted_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.contains("text", F.lit("###"))).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY link HAVING count(*) > 1")
def e15_duplicate_links(spark: SparkSession, sf: str) -> DataFrame:
    md = F.regexp_replace("html", 'href="([^"]+)"', "[x]($1)")
    return health.duplicate_links(table(spark, sf, "pages").select(md.alias("line")), "line")


@query("""SELECT count(*) AS scanned, count(*) FILTER (WHERE regexp_matches(lower(string_split(url, '/')[-1]), '^(p|a)')) AS matched FROM pages""")
def e17_retag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").agg(F.count("*").alias("scanned"), F.count_if(classify.is_curated_correction(F.col("url"), ["p", "a"])).alias("matched"))


@query("SELECT conv_id, turn, starts_with(text, 'The ') OR starts_with(text, 'Of ') AS system_turn, role IN ('user', 'system') AS nudges, list_has_any(string_split(text, ' '), ['that', 'und']) AS skipped FROM conversations")
def c19_turn_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", classify.is_system_turn(t, ["The ", "Of "]).alias("system_turn"), classify.is_nudge_tool(F.col("role"), ["user", "system"]).alias("nudges"), F.arrays_overlap(F.split(t, " "), F.array(F.lit("that"), F.lit("und"))).alias("skipped"))


@query("SELECT conv_id, turn, md5((role || chr(10) || text)[1:16384]) AS payload FROM conversations")
def b15_tool_text(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("text").alias("command"), F.col("role").alias("description")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.tool_text(F.lit("Bash"), payload)).alias("payload"))


@query("""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
s AS (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '^\\s*(The|Of|In) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
g AS (SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY doc_id, section)
SELECT doc_id, section, count(*) AS parts, sum(length(body[f + 1:f + 500])) AS chars, max(md5(body)) AS body FROM (SELECT *, unnest(range(0, length(body), 500)) AS f FROM g WHERE body <> '') GROUP BY doc_id, section""")
def b1_sections(spark: SparkSession, sf: str) -> DataFrame:
    parts = tx.split_sections(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", HEADING, 500)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("doc_id", "section").agg(F.count("*").alias("parts"), F.sum(F.length("text")).alias("chars"), F.md5(whole).alias("body"))


@query("""SELECT id, origin_project FROM (SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS id, source AS origin_project, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY source, doc_id) AS r FROM documents WHERE source <> 'src3') WHERE r = 1""")
def d11_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated projects stay out; of equal contents the first project's is mirrored."""
    rows = table(spark, sf, "documents").where("source <> 'src3'").withColumnRenamed("source", "origin_project")
    return capture.first_by_content(rows, "text", ["origin_project", "doc_id"]).select("id", "origin_project")


@query("""WITH t AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substring(t, 1, 139) AS h FROM t)
SELECT doc_id, '[0.500] (' || source || ' / ' || lang || ') ' || CASE WHEN length(t) <= 140 THEN t ELSE rtrim(CASE WHEN substring(t, 140, 1) <> ' ' AND contains(h, ' ') AND length(h) - instr(reverse(h), ' ') > 0 THEN substring(h, 1, length(h) - instr(reverse(h), ' ')) ELSE h END) || '…' END AS line FROM h""")
def d12_result_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", search.result_line(F.lit(0.5), F.col("source"), F.col("lang"), F.col("text")).alias("line"))


@query("SELECT user_id, count(*) AS access_count, max(ts) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY user_id")
def d8_access_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


@query("""SELECT doc_id AS id, n_chars % 100 AS signal_weight FROM documents ORDER BY signal_weight DESC, doc_id DESC LIMIT 25""")
def h5_backfill_order(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", "signal_weight").orderBy(F.desc("signal_weight"), F.desc("id")).limit(25)


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def i2_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("""SELECT file_path, count(*) AS n, sum(v) AS v FROM (SELECT source AS file_path, doc_id AS v FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)
UNION ALL SELECT source, doc_id FROM documents WHERE doc_id % 50 = 0) GROUP BY file_path""")
def j1_replace_by_file(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("v"))
    return readers.replace_by_file(d, d.where("v % 50 = 0")).groupBy("file_path").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("""WITH f AS (SELECT url || '#' || page_id AS path, page_id % 17 AS mtime FROM pages)
SELECT path, mtime FROM f WHERE mtime > 8 OR (mtime = 8 AND NOT contains(path, '1'))""")
def l1_changed_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "pages").select(F.concat_ws("#", "url", "page_id").alias("path"), (F.col("page_id") % 17).alias("mtime"))
    return readers.changed_files(f, f.where("mtime = 8 and path like '%1%'").select("mtime", "path"))


@query("""WITH f AS (SELECT url || '#' || page_id AS path, page_id % 17 AS mtime FROM pages) SELECT mtime, path FROM f WHERE mtime = (SELECT max(mtime) FROM f)""")
def l1_next_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return readers.next_watermark(table(spark, sf, "pages").select(F.concat_ws("#", "url", "page_id").alias("path"), (F.col("page_id") % 17).alias("mtime")))


@query(f"""WITH p AS (SELECT count(*) FILTER (WHERE s = 'pending') AS n FROM (SELECT {_STATE} AS s FROM orders)),
v AS (SELECT count(*) AS n, count(vec_id) AS k FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
l AS (SELECT count(*) FILTER (WHERE coalesce(k, '') <> coalesce(u, '')) AS n FROM (SELECT max(o_orderdate)::VARCHAR AS u, (max(o_orderdate) FILTER (WHERE o_orderstatus = 'F'))::VARCHAR AS k FROM orders GROUP BY o_custkey)),
a AS (SELECT 'pending_queue' AS name, n <= 40 AS ok, n || ' pending' AS detail FROM p UNION ALL SELECT 'vector_coverage', k / n::DOUBLE >= 0.99, k || ' of ' || n FROM v UNION ALL SELECT 'stale_lineage', n = 0, n || ' stale' FROM l)
SELECT *, (SELECT count(*) FROM a WHERE NOT ok) AS n_red FROM a""")
def k19_health_gate(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf)
    threads = o.groupBy("thread_id").agg(F.max("date").alias("last_updated"), F.max(F.when(F.col("state") == "confirmed", F.col("date"))).alias("lineage_cache_key"))
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return health.gate([health.pending_queue(o), health.vector_coverage(chunks, vectors), health.stale_lineage(threads)])


_BEATS = """b AS (SELECT user_id, event_type, arg_max(value > 1.0, event_id)::INT AS ok, floor(epoch(max(ts) FILTER (WHERE value > 1.0))) AS t FROM events GROUP BY user_id, event_type),
p AS (SELECT user_id, max(ok) FILTER (WHERE event_type = 'click') AS o0, max(t) FILTER (WHERE event_type = 'click') AS t0, max(ok) FILTER (WHERE event_type = 'view') AS o1, max(t) FILTER (WHERE event_type = 'view') AS t1,
max(ok) FILTER (WHERE event_type = 'signup') AS os, max(t) FILTER (WHERE event_type = 'signup') AS ts, max(ok) FILTER (WHERE event_type = 'purchase') AS oe, max(t) FILTER (WHERE event_type = 'purchase') AS te,
max(ok) FILTER (WHERE event_type = 'error') AS oc, max(t) FILTER (WHERE event_type = 'error') AS tc, (SELECT floor(epoch(max(ts))) FROM events) AS now FROM b GROUP BY user_id),
x AS (SELECT *, CASE WHEN t0 IS NULL THEN t1 WHEN t1 IS NULL THEN t0 ELSE greatest(t0, t1) END AS turn FROM p)"""
_PROBLEMS = """[CASE WHEN o0 IS NULL THEN 'click:no-rows' WHEN o0 <> 1 THEN 'click:latest-errored' WHEN t0 IS NULL THEN 'click:bad-ts' WHEN now - t0 > 172800 THEN 'click:stale' END,
CASE WHEN o1 IS NULL THEN 'view:no-rows' WHEN o1 <> 1 THEN 'view:latest-errored' WHEN t1 IS NULL THEN 'view:bad-ts' WHEN now - t1 > 172800 THEN 'view:stale' END,
CASE WHEN os <> 1 THEN 'signup:latest-errored' WHEN turn - coalesce(ts, -1e12) > 172800 AND te - coalesce(ts, -1e12) > 600 AND turn > te AND now - te > 600 THEN 'signup:boundary-cycle-without-start' END,
CASE WHEN oc <> 1 THEN 'error:latest-errored' WHEN te - coalesce(tc, -1e12) > 3600 AND now - te > 3600 THEN 'error:missed-boundary' END,
CASE WHEN oe <> 1 THEN 'purchase:latest-errored' WHEN tc - coalesce(te, -1e12) > 3600 AND now - tc > 3600 THEN 'purchase:missed-boundary' END]"""


@query(f"WITH {_BEATS} SELECT user_id, len(f) = 0 AS ok, CASE WHEN len(f) = 0 THEN 'all 5 hooks consistent' ELSE array_to_string(f, ', ') END AS detail FROM (SELECT user_id, list_filter({_PROBLEMS}, lambda y: y IS NOT NULL) AS f FROM x)")
def k19_3_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events are the heartbeats of a project's five hooks."""
    e = table(spark, sf, "events")
    flag = e.withColumn("ok", F.col("value") > 1)
    latest = flag.groupBy("user_id", F.col("event_type").alias("hook")).agg(F.max_by("ok", "event_id").alias("last_ok"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("newest_success"))
    rows = health.heartbeats(latest, e.agg(F.max("ts").alias("now")), ["click", "view"], "signup", "purchase", ["error"], "user_id")
    return rows.select("user_id", "ok", "detail")


@query("""WITH r AS (SELECT event_id AS id, event_type AS hash, event_id % 7 AS session_id, floor(value)::BIGINT AS corpus_sig, user_id AS project FROM events)
SELECT id, coalesce(lag(hash) OVER w = hash AND lag(session_id) OVER w <> session_id AND lag(corpus_sig) OVER w <> corpus_sig, false) AS flag FROM r WINDOW w AS (PARTITION BY project ORDER BY id)""")
def k17_repeated_renders(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of an event's type, with a health line that differs in each."""
    block = F.concat(F.lit("## block\n- "), "event_type", F.lit("\nmemory-health (last run "), F.col("ts").cast("string"), F.lit("): ok\n"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), health.stable_hash(block).alias("hash"), (F.col("event_id") % 7).alias("session_id"), F.floor("value").alias("corpus_sig"), F.col("user_id").alias("project"))
    return health.repeated_renders(e).select("id", "flag")


@query("SELECT 'deprecated_tokens' AS name, false AS ok, 'tion, und' AS detail WHERE (SELECT bool_or(contains(text, 'tion')) AND bool_or(contains(text, 'und')) AND NOT bool_or(contains(text, 'zzzz')) FROM conversations)")
def k19_10_deprecated(spark: SparkSession, sf: str) -> DataFrame:
    return health.deprecated_tokens(table(spark, sf, "conversations"), "text", ["tion", "und", "zzzz"])


@query("SELECT event_id, user_id, event_type, r AS delivery FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2")
def l5_damping_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.read_stream(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return jobs.drain(jobs.damped_stream(rows, ["user_id", "event_type"], "event_id", 2), "damped").select("event_id", "user_id", "event_type", "delivery")


@query("SELECT DISTINCT user_id, event_type FROM events")
def l6_dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.read_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.drain(jobs.dedup_stream(rows, F.concat_ws("/", "user_id", "event_type"), "ts", "3650 days").select("user_id", "event_type"), "dedup")


@query("SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts)::TIMESTAMP, event_type) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def l7_windowed_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.read_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.drain(jobs.windowed_counts(rows, "ts", "event_type"), "windows")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_SECTIONS = """l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
s AS (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '^\\s*(The|Of|In) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)"""


@query(f"WITH {_SECTIONS} SELECT doc_id, section, count(*) AS n_lines FROM s GROUP BY doc_id, section ORDER BY n_lines DESC, doc_id, section LIMIT 5")
def e16_largest_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.sections(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", HEADING)
    lines = F.length("raw") - F.length(F.replace(F.col("raw"), F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", "section", lines.cast("bigint").alias("n_lines")).orderBy(F.desc("n_lines"), "doc_id", "section").limit(5)


@query(f"""WITH {_SECTIONS}, g AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS raw, section > 0 AND bool_or(contains(line, 'that')) AS moved FROM s GROUP BY doc_id, section)
SELECT doc_id, section, md5(raw) AS raw, moved, CASE WHEN moved THEN row_number() OVER (PARTITION BY doc_id, moved ORDER BY section DESC) END AS place FROM g""")
def j11_archive_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with a mark move to an archive, the last first; the others stay."""
    kept, moved = capture.archive_sections(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", F.contains("raw", F.lit("that")), HEADING)
    rows = kept.withColumn("moved", F.lit(False)).withColumn("place", F.lit(None).cast("int")).unionByName(moved.withColumn("moved", F.lit(True)))
    return rows.select("doc_id", "section", F.md5("raw").alias("raw"), "moved", "place")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND NOT starts_with(p_name, '_')")
def f10_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Files that no index links to; names that begin with an underscore don't count."""
    p = table(spark, sf, "part").where(~F.col("p_name").startswith("_"))
    return p.select("p_partkey").join(table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS date, {_STATE} AS state FROM orders),
r AS (SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY date DESC, id) AS place FROM o)
SELECT state, id, place FROM r WHERE (state = 'confirmed' AND place <= 20) OR (state = 'pending' AND place <= 15)""")
def k18_digest(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = _outcomes(spark, sf).withColumn("date", F.substring("date", 1, 10))
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date"), "id"))
    few = o.select("state", "id", place.alias("place")).where("place <= 20")
    return few.where(((F.col("state") == "confirmed") & (F.col("place") <= 20)) | ((F.col("state") == "pending") & (F.col("place") <= 15)))


@query("""WITH l AS (SELECT user_id % 50 AS hook, arg_max({'t': ts, 'ok': value <= 300, 'd': event_type}, event_id) AS r FROM events WHERE user_id % 50 > 3 GROUP BY 1), n AS (SELECT max(ts) - INTERVAL 12 HOUR AS now FROM events),
a AS (SELECT h.hook, r, (epoch(now)::BIGINT - floor(epoch(r.t))::BIGINT) / 86400 AS age_days FROM (SELECT DISTINCT user_id % 50 AS hook FROM events) h LEFT JOIN l USING (hook), n)
SELECT hook, CASE WHEN r IS NULL THEN 'none' WHEN age_days > 0.1 THEN 'stale' WHEN NOT r.ok THEN 'errored' ELSE 'ok' END AS state, round(age_days, 9) AS age_days, r.d AS detail FROM a""")
def k21_health_line(spark: SparkSession, sf: str) -> DataFrame:
    """Users as hooks: some have no run at all, some an old one, some a failed one."""
    e = table(spark, sf, "events").withColumn("hook", F.col("user_id") % 50)
    beats = e.where("hook > 3").select(F.col("event_id").alias("id"), "hook", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), (F.col("value") <= 300).alias("ok"), F.col("event_type").alias("detail"))
    now = e.agg(F.max("ts")).first()[0] - timedelta(hours=12)
    return health.health_line(beats, F.lit(now), e, 0.1).withColumn("age_days", F.round("age_days", 9))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '([a-z]+tion[a-z]+)', 1) AS a FROM documents WHERE source IN ('src1', 'src2') OR contains(text, '###'))
SELECT doc_id, len(list_distinct(a)) AS n_symbols FROM d WHERE len(a) > 0""")
def k5_stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(classify.is_narrative(F.col("source"), F.col("text"), ["src1", "src2"], ["###"]))
    return d.select("doc_id", F.size(tx.extract_symbols(F.col("text"), ["([a-z]+tion[a-z]+)"])).cast("bigint").alias("n_symbols")).where("n_symbols > 0")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '([a-z]+tion[a-z]+)', 1) AS a FROM documents WHERE source = 'src1'),
s AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS s FROM d WHERE len(a) > 0)
SELECT doc_id, array_to_string(s[1:5], ', ') || CASE WHEN len(s) > 5 THEN ' (+' || (len(s) - 5) || ' more)' ELSE '' END AS citation FROM s""")
def k5_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Narrative rows with their first five symbols and how many more there are."""
    d = table(spark, sf, "documents").where(classify.is_narrative(F.col("source"), F.col("text"), ["src1"], []))
    s = d.select("doc_id", tx.extract_symbols(F.col("text"), ["([a-z]+tion[a-z]+)"]).alias("s")).where(F.size("s") > 0)
    more = F.when(F.size("s") > 5, F.format_string(" (+%d more)", F.size("s") - 5)).otherwise("")
    return s.select("doc_id", F.concat(F.array_join(F.slice("s", 1, 5), ", "), more).alias("citation"))


@query(f"""WITH o AS (SELECT o_custkey AS thread_id, o_orderkey AS id, o_orderdate::DATE::VARCHAR AS date, {_STATE} AS state FROM orders)
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY date, id) AS place, count(*) OVER (PARTITION BY thread_id) AS n, date || ' [' || state || '] ' || id AS line FROM o""")
def k14_lineage_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Each thread's outcomes as lines by place, oldest first; n + 1 - place is the place in the fallback, newest first."""
    o = _outcomes(spark, sf).withColumn("date", F.substring("date", 1, 10))
    return capture.lineage_lines(o.withColumn("line", F.format_string("%s [%s] %d", "date", "state", "id")), "thread_id", ["date", "id"], "line")


@query()
def d3_bm25_stemmed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies of Porter stems."""
    d = table(spark, sf, "conversations").select("conv_id", F.explode(F.array_distinct(stemmed(search.tokens(F.col("text"))))).alias("stem"))
    return d.groupBy("stem").agg(F.count("*").alias("df"))


@query()
def m1_embed(spark: SparkSession, sf: str) -> DataFrame:
    rows = embed.with_embedding(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", embed.HashEmbedder(32))
    return rows.select("conv_id", "turn", "embedding", "embed_error")


@query("SELECT (SELECT count(*) FROM documents) AS total, count(*) AS embedded, 0 AS failed, (SELECT count(*) FROM documents) - count(*) AS skipped FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def l8_backfill(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return embed.backfill_summary(chunks, embed.backfill(chunks, vectors, "text", embed.HashEmbedder()))


@query("SELECT p_partkey, p_brand, count(*) AS n, sum(l_quantity)::DOUBLE AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ROLLUP (p_brand, p_partkey) HAVING p_partkey IS NULL")
def e18_rollup(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.rollup("p_brand", "p_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("q")).where("p_partkey is null")


@query("""WITH m AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT count(*) AS n FROM m WHERE role = 'user' AND p = 'assistant'""")
def f9_adjacent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return capture.correction_events(_messages(spark, sf), [""], skip_harness=False).agg(F.count("*").alias("n"))


#: Conversations as 16 growing logs, in the order of their turns.
_LOGS = """m AS (SELECT conv_id % 16 AS log, conv_id * 1000 + turn AS pos, role, text FROM conversations)"""


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    """The logs are mined twice: when they have a part of their lines, and when they have all; the second run reads only what came in between."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MINED:
        folder = mining.state_folder(spark, "mining")
        c = table(spark, sf, "conversations")
        record = F.to_json(F.struct(F.struct(F.col("role"), F.col("text").alias("content")).alias("message"), F.lit("2024-01-05T00:00:00").alias("timestamp")))
        rows = c.select((F.col("conv_id") % 16).alias("log"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), record.alias("line"))
        middle = 500 * (c.agg(F.max("conv_id")).first()[0] or 0)
        for part in (rows.where(F.col("pos") < middle), rows):
            mining.write_logs(part, "log", ["pos"], "line", f"{folder}/logs")
            found = mining.mine(spark, f"{folder}/logs", f"{folder}/state", {"from": "start", "bytes": str(1 << 40)}, corrections=CORRECTIONS, decisions=DECISIONS, dead_ends=CORRECTIONS)
        _MINED[key] = found
    return _MINED[key]


_MINED: dict[tuple[str, str], DataFrame] = {}


@query(f"""WITH {_LOGS}, p AS (SELECT log, pos, role, text, lag(role) OVER w AS pr, lag(text) OVER w AS context FROM m WINDOW w AS (PARTITION BY log ORDER BY pos)), h AS (SELECT * FROM p WHERE role = 'user' AND pr = 'assistant' AND {_any('text', CORRECTIONS)})
SELECT log, row_number() OVER (PARTITION BY log ORDER BY pos) AS n, md5(text) AS text, md5(context) AS context FROM h""")
def l4_mined_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of two runs over growing logs, numbered by their bytes."""
    found = _mined(spark, sf).where("kind = 'correction'").select(F.col("session_id").cast("int").alias("log"), "tick", F.md5("text").alias("text"), F.md5("context").alias("context"))
    return placed(found, ["log"], ["tick"], "n").select("log", "n", "text", "context")


@query(f"""WITH {_LOGS}, s AS (SELECT log, pos, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM m),
x AS (SELECT log, pos, i AS s, ss[i] AS t FROM (SELECT log, pos, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
k AS (SELECT log, pos, s, t, 'decision' AS kind FROM x WHERE {_any('t', DECISIONS)} UNION ALL SELECT log, pos, s, t, 'dead_end' AS kind FROM x WHERE {_any('t', CORRECTIONS)}),
g AS (SELECT log, pos, s, kind, {_clip('t', 200)} AS title, {_clip('t', 600)} AS rationale FROM k WHERE length({_clip('t', 200)}) >= 40 AND NOT regexp_matches({_clip('t', 200)}, '{_ECHO}')),
f AS (SELECT *, row_number() OVER (PARTITION BY log, kind, title ORDER BY pos, s) AS r FROM g),
c AS (SELECT log, kind, row_number() OVER (PARTITION BY log, kind ORDER BY pos, s) AS place, title, md5(rationale) AS rationale FROM f WHERE r = 1) SELECT * FROM c WHERE place <= 25""")
def l4_mined_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the same runs."""
    return _mined(spark, sf).where("kind <> 'correction'").select(F.col("session_id").cast("int").alias("log"), "kind", "place", "title", F.md5("text").alias("rationale"))
