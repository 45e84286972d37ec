"""Registered queries of composed flows: prompts, nudges, corrections, backfills, gates and telemetry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memspark.functions import classify, payload, text as tx
from memspark.jobs.catalog import _DF, _IN_ORDER, _STATE, CORRECTIONS, DECISIONS, INVESTIGATIONS, TOK, _any, _clip, _messages, _outcomes, _topic, kept_index, query
from memspark.operators import capture, health, index, prompts, relevance, telemetry
from memspark.session import materialize, scratch_path, table
from memspark.sources import readers

NOW = "2024-02-01 00:00:00"
SYMBOL = "([a-z]+tion[a-z]+)"
DECIDING = ("src1", "src2", "src4", "src6", "src7", "src9", "src10", "src12")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks with all columns that flows read."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    date = F.when(F.col("doc_id") % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 20).cast("int")).cast("string")).otherwise("no date")
    return d.select(
        date.alias("date"), none.alias("ingested_at"), F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string")).alias("module"), none.alias("aliases"), none.alias("file_path"),
        (F.col("n_chars") % 100).cast("int").alias("signal_weight"), F.lit(False).alias("do_not_rebuild"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_correction"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("is_decision"),
    )


def _threads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as threads (thread_id, name, lineage), and their words."""
    c = table(spark, sf, "conversations")
    threads = c.select(F.col("conv_id").alias("thread_id")).distinct().withColumn("name", F.concat(F.lit("thread "), F.col("thread_id").cast("string"))).withColumn("lineage", F.concat(F.lit("lineage of "), F.col("thread_id").cast("string")))
    told = c.select(F.col("conv_id").alias("thread_id"), "role", F.col("text"))
    return threads, prompts.thread_texts(threads, told.where("role = 'assistant'").withColumnRenamed("text", "title"), told.where("role <> 'assistant'").withColumnRenamed("text", "approach"))


_WORDS = "unnest(list_distinct(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}_]+')))"
_THREAD_WORDS = f"""tw AS (SELECT DISTINCT thread_id, term FROM (SELECT conv_id AS thread_id, {_WORDS.format(c='lower(text)')} AS term FROM conversations UNION ALL SELECT conv_id, {_WORDS.format(c="'thread ' || conv_id")} FROM conversations))"""


@query(f"WITH {_THREAD_WORDS} SELECT thread_id, term AS item_text FROM tw")
def k3_thread_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _threads(spark, sf)[1]


@query("SELECT doc_id AS item_id, md5(lower(concat_ws(' ', nullif(text, ''), 'm' || (doc_id % 5)))) AS item_text FROM documents")
def k4_item_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    text = relevance.item_text(F.nullif("content", F.lit("")), F.nullif("module", F.lit("")), F.nullif("aliases", F.lit("")), F.nullif("file_path", F.lit("")))
    return c.select(F.col("id").alias("item_id"), F.md5(text).alias("item_text"))


_PROMPTS = f"""pr AS (SELECT item_id AS prompt_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 3 END AS session_id, text AS prompt,
{_any('text', CORRECTIONS)} AND NOT {_any('text', ['zzz'])} AS build, {_any('text', INVESTIGATIONS)} AS investigate, {_any('text', DECISIONS)} AS decide, starts_with(text, 'The ') AS system_turn FROM benchmark),
act AS (SELECT * FROM pr WHERE NOT system_turn AND (build OR investigate OR decide)),
docs AS (SELECT doc_id AS id, text, source, 'm' || (doc_id % 5) AS module, n_chars % 100 AS w, coalesce(toxic = 1, false) AS corr, coalesce(quality = 0, false) AS deci FROM documents LEFT JOIN labels USING (doc_id)),
toks AS (SELECT doc_id AS id, {TOK.format(c='text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
qt AS (SELECT prompt_id, unnest({TOK.format(c='prompt')}) AS term FROM act),
q AS (SELECT prompt_id, term, count(*) AS times FROM qt GROUP BY prompt_id, term),
ex AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM dfq, st),
bm AS (SELECT prompt_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score FROM tf JOIN wt USING (term) JOIN q USING (term), st GROUP BY prompt_id, id),
rk AS (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) - 1 AS r FROM bm QUALIFY r < 30),
fin AS (SELECT prompt_id, id, r, round(round(1.0::DOUBLE / (61 + r), 12) * (1 + CASE WHEN w = 0 THEN 10 ELSE w END / 100.0::DOUBLE), 12) AS f, corr, deci, w FROM rk JOIN docs USING (id)),
found AS (SELECT prompt_id, id, 0 AS leg, row_number() OVER (PARTITION BY prompt_id ORDER BY f DESC, id) - 1 AS rank FROM fin WHERE corr OR deci OR w >= 50 QUALIFY rank < 10
UNION ALL SELECT prompt_id, id, 1, row_number() OVER (PARTITION BY prompt_id ORDER BY f DESC, id) - 1 AS rank FROM fin WHERE corr AND r < 15 QUALIFY rank < 5),
d AS ({_DF}), n AS (SELECT count(*) AS n FROM documents),
pt AS (SELECT prompt_id, unnest(ts) AS term FROM (SELECT prompt_id, list_filter({_IN_ORDER.replace('text', 'prompt')}, lambda t, i: list_position({_IN_ORDER.replace('text', 'prompt')}, t) = i)[1:32] AS ts FROM act)),
i AS (SELECT prompt_id, term, n, greatest(ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE), 0) AS idf FROM pt LEFT JOIN d USING (term), n),
iw AS (SELECT id, {_WORDS.format(c="lower(concat_ws(' ', nullif(text, ''), module))")} AS term FROM docs WHERE id IN (SELECT id FROM found)),
ok AS (SELECT prompt_id, id FROM (SELECT DISTINCT prompt_id, id FROM found) JOIN i USING (prompt_id) JOIN iw USING (id, term) GROUP BY prompt_id, id HAVING CASE WHEN max(n) < 50 THEN count(*) ELSE count(*) FILTER (WHERE idf >= 3) END >= 2),
s0 AS (SELECT f.prompt_id, f.leg, f.rank, f.id, docs.module, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, CASE WHEN source = 'src1' THEN regexp_extract_all(text, '{SYMBOL}', 1) ELSE [] END AS every FROM found f JOIN ok USING (prompt_id, id) JOIN docs USING (id)),
sh AS (SELECT *, list_filter(every, lambda x, j: list_position(every, x) = j) AS cited, '  - [' || module || '] ' || {_clip('t', 160)} || '  (' || source || ')' AS line FROM s0),
per AS (SELECT prompt_id, session_id, count(*) AS n_items, list(module ORDER BY leg, rank) AS modules, len(flatten(list(cited))) > 0 AS cites, string_agg(line, chr(10) ORDER BY leg, rank) AS body,
string_agg(CASE WHEN len(cited) > 0 THEN '  - [' || CASE WHEN id % 7 > 0 THEN (31 - id % 20)::VARCHAR ELSE '?' END || 'd old] ' || source || ': symbols ' || array_to_string(cited[1:5], ', ') || CASE WHEN len(cited) > 5 THEN ' (+' || (len(cited) - 5) || ' more)' ELSE '' END END, chr(10) ORDER BY leg, rank) AS stale FROM sh JOIN pr USING (prompt_id) GROUP BY prompt_id, session_id),
reb AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt_id) AS k FROM per QUALIFY session_id IS NULL OR k <= 3),
sta AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY prompt_id) AS k2 FROM reb WHERE cites QUALIFY session_id IS NULL OR k2 <= 3),
{_THREAD_WORDS},
tg AS (SELECT prompt_id, thread_id, count(*) AS m, round(sum(idf), 9) AS s, round(max(idf), 9) AS x, max(n) AS n FROM i JOIN tw USING (term) WHERE prompt_id IN (SELECT prompt_id FROM act WHERE build OR decide) GROUP BY prompt_id, thread_id),
th AS (SELECT prompt_id, thread_id, row_number() OVER (PARTITION BY prompt_id ORDER BY s DESC, m DESC, thread_id) AS place FROM tg WHERE m >= 2 AND (n < 50 OR (s >= 7 AND x >= 3)) QUALIFY place <= 2),
lin AS (SELECT prompt_id, session_id, thread_id, row_number() OVER (PARTITION BY session_id, thread_id ORDER BY prompt_id) AS k FROM th JOIN pr USING (prompt_id) QUALIFY session_id IS NULL OR k <= 2),
blocks AS (SELECT prompt_id, 'rebuild' AS kind, 'dnr' AS item, body FROM reb UNION ALL SELECT prompt_id, 'stale', 'stale', stale FROM sta UNION ALL SELECT prompt_id, 'lineage', 'thread:' || thread_id, 'lineage of ' || thread_id FROM lin),
mt AS (SELECT prompt_id, 'dnr' AS item, term FROM (SELECT DISTINCT prompt_id, id FROM sh) JOIN i USING (prompt_id) JOIN iw USING (id, term) WHERE idf >= 3 OR n < 50 UNION SELECT lin.prompt_id, 'thread:' || thread_id, term FROM lin JOIN i USING (prompt_id) JOIN tw USING (thread_id, term)),
ml AS (SELECT prompt_id, list(item || ' ' || terms ORDER BY item) AS matched FROM (SELECT prompt_id, item, string_agg(term, ',' ORDER BY term) AS terms FROM mt GROUP BY prompt_id, item) GROUP BY prompt_id),
wish AS (SELECT prompt_id, 'dnr' AS item FROM per UNION ALL SELECT prompt_id, 'stale' FROM reb WHERE cites UNION ALL SELECT prompt_id, 'thread:' || thread_id FROM th)"""


def _flow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.when(F.col("item_id") % 5 != 0, F.col("item_id") % 3).alias("session_id"), F.col("item_id").alias("pos"), F.col("text").alias("prompt"), F.lit(None).cast("array<float>").alias("vector"))
    turned = materialize(prompts.turns(b, CORRECTIONS, ["zzz"], INVESTIGATIONS, DECISIONS, ["The "]), "turns")
    wanted = turned.select(F.explode(tx.prompt_tokens(F.col("prompt"))).alias("term"))
    kept = kept_index(spark, sf)
    idfs = materialize(index.token_idf(kept, wanted), "idfs")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    threads, words = _threads(spark, sf)
    return prompts.prompt_pipeline(turned, _chunks(spark, sf), vectors, threads, words, idfs, F.lit(NOW).cast("timestamp"), [SYMBOL], ["src1"], [], kept)


@query(f"WITH {_PROMPTS} SELECT prompt_id, kind, item, body FROM blocks")
def k6_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _flow(spark, sf)[0].select("prompt_id", "kind", "item", "body")


@query(f"""WITH {_PROMPTS} SELECT prompt_id, session_id, sha256(prompt) AS prompt_hash, prompt[1:200] AS prompt_truncated, system_turn, build AND NOT system_turn AS build, investigate AND NOT system_turn AS investigate, decide AND NOT system_turn AS decide,
coalesce((SELECT count(*) FROM found f WHERE f.prompt_id = pr.prompt_id), 0) AS retrieved, coalesce((SELECT list_filter(modules, lambda m, j: list_position(modules, m) = j) FROM per WHERE per.prompt_id = pr.prompt_id), []) AS topics,
prompt_id IN (SELECT prompt_id FROM reb) AS rebuild_shown, prompt_id IN (SELECT prompt_id FROM sta) AS stale_shown, coalesce((SELECT list(item ORDER BY item) FROM blocks b WHERE b.prompt_id = pr.prompt_id AND kind = 'lineage'), []) AS threads,
coalesce((SELECT list(item ORDER BY item) FROM wish w WHERE w.prompt_id = pr.prompt_id AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.prompt_id = w.prompt_id AND b.item = w.item)), []) AS suppressed,
CASE WHEN system_turn THEN ['system_turn The '] ELSE coalesce((SELECT matched FROM ml WHERE ml.prompt_id = pr.prompt_id), []) END AS matched FROM pr""")
def k6_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry rows; matched tokens as ``item token,token``, without their idf."""
    told = F.transform(F.map_entries("matched"), lambda x: F.concat(x["key"], F.lit(" "), F.coalesce(F.array_join(F.array_sort(F.json_object_keys(x["value"])), ","), x["value"])))
    return _flow(spark, sf)[1].withColumn("matched", told)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts as tool calls: every third by another tool, ids ascending in a session."""
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("call_id"), (F.col("item_id") % 3).alias("session_id"), F.col("item_id").alias("pos"), F.when(F.col("item_id") % 4 == 0, "Read").otherwise("Bash").alias("tool"), "text", F.lit(None).cast("array<float>").alias("vector"))


_HITS = f"""pr AS (SELECT item_id AS prompt_id, text AS prompt FROM benchmark), act AS (SELECT * FROM pr WHERE prompt_id % 4 <> 0 AND NOT contains(lower(prompt), 'whtion') AND {_any('prompt', INVESTIGATIONS)}),
docs AS (SELECT doc_id AS id, n_chars % 100 AS w, coalesce(toxic = 1, false) AS corr, coalesce(quality = 0, false) AS deci FROM documents LEFT JOIN labels USING (doc_id)),
toks AS (SELECT doc_id AS id, {TOK.format(c='text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
q AS (SELECT prompt_id, term, count(*) AS times FROM (SELECT prompt_id, unnest({TOK.format(c='prompt')}) AS term FROM act) GROUP BY prompt_id, term),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM dfq, st),
bm AS (SELECT prompt_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score FROM tf JOIN wt USING (term) JOIN q USING (term), st GROUP BY prompt_id, id),
rk AS (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) - 1 AS r FROM bm QUALIFY r < 15),
fin AS (SELECT prompt_id, id, round(round(1.0::DOUBLE / (61 + r), 12) * (1 + CASE WHEN w = 0 THEN 10 ELSE w END / 100.0::DOUBLE), 12) AS f FROM rk JOIN docs USING (id) WHERE corr OR deci OR w >= 50),
found AS (SELECT prompt_id, id, f, row_number() OVER (PARTITION BY prompt_id ORDER BY f DESC, id) - 1 AS rank FROM fin QUALIFY rank < 5),
hits AS (SELECT prompt_id AS call_id, id, rank, row_number() OVER (PARTITION BY prompt_id ORDER BY rank) AS place FROM found WHERE f >= 0.01)"""


def _nudge_hits(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return prompts.nudge_hits(_calls(spark, sf), _chunks(spark, sf), vectors, ["whtion"], intent=classify.investigation_intent(F.col("text"), INVESTIGATIONS), kept=kept_index(spark, sf))


@query(f"WITH {_HITS} SELECT call_id, id, place FROM hits WHERE place <= 3")
def k7_pre_nudges(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.pre_nudges(_nudge_hits(spark, sf)).select("call_id", "id", "place")


@query()
def k8_post_nudges(spark: SparkSession, sf: str) -> DataFrame:
    calls = _calls(spark, sf)
    hits = materialize(_nudge_hits(spark, sf), "hits")
    return prompts.post_nudges(hits, calls, hits.where("id % 10 = 0").join(calls.select("call_id", "session_id"), "call_id").select("session_id", "id"))


_RESPONSE = "chr(10) || role || chr(10) || '}, ' || text || '\", ]' || chr(10) || chr(10) || ':' || role"


@query(f"SELECT conv_id, turn, md5(({_RESPONSE})[1:16384]) AS strings FROM conversations")
def b16_response_text(spark: SparkSession, sf: str) -> DataFrame:
    """Strings of a nested response; values begin and end with JSON's own marks."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", _response().alias("response"))
    return rows.select("conv_id", "turn", F.md5(payload.nested_strings(F.col("response"))).alias("strings"))


def _response():
    body = F.concat(F.lit("}, "), F.col("text"), F.lit('", ]'))
    return F.to_json(F.struct(F.struct(F.col("turn").alias("n"), F.array(F.col("role")).alias("who")).alias("meta"), F.array(F.struct(body.alias("body"))).alias("parts"), F.lit(True).alias("flag"), F.concat(F.lit(":"), F.col("role")).alias("end")))


@query(f"""SELECT conv_id, turn, t.tool, md5((CASE t.tool WHEN 'Edit' THEN role || chr(10) || text || chr(10) WHEN 'Grep' THEN text || chr(10) || role || chr(10) WHEN 'Bash' THEN text || chr(10) ELSE '' END || {_RESPONSE})[1:16384]) AS strings FROM conversations, (VALUES ('Edit'), ('Grep'), ('Bash'), ('Read')) t(tool)""")
def b16_post_tool_text(spark: SparkSession, sf: str) -> DataFrame:
    """Input fields of the tool and then the response; fields that are empty or no strings don't count."""
    given = F.to_json(F.struct(F.col("role").alias("file_path"), F.col("text").alias("old_string"), F.lit("").alias("new_string"), F.col("text").alias("pattern"), F.col("role").alias("path"), F.col("turn").alias("description"), F.col("text").alias("command")))
    tools = F.explode(F.array(*(F.lit(t) for t in ("Edit", "Grep", "Bash", "Read")))).alias("tool")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tools, given.alias("given"), _response().alias("response"))
    return rows.select("conv_id", "turn", "tool", F.md5(payload.post_tool_text(F.col("tool"), F.col("given"), F.col("response"))).alias("strings"))


@query("""SELECT conv_id, turn, t.tool, md5(CASE t.tool WHEN 'Edit' THEN role || chr(10) || text || chr(10) || conv_id WHEN 'Write' THEN role || chr(10) || text WHEN 'Bash' THEN conv_id || chr(10) || text WHEN 'Agent' THEN role || chr(10) || conv_id || chr(10) || text WHEN 'NotebookEdit' THEN role || chr(10) || text ELSE '' END) AS payload
FROM conversations, (VALUES ('Edit'), ('Write'), ('Bash'), ('Agent'), ('NotebookEdit'), ('Read')) t(tool)""")
def b15_tool_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Every tool's payload gives its own fields in its own order."""
    text, role, conv = F.col("text"), F.col("role"), F.col("conv_id").cast("string")
    every = F.struct(role.alias("file_path"), text.alias("old_string"), conv.alias("new_string"), text.alias("content"), conv.alias("description"), text.alias("command"), role.alias("subagent_type"), text.alias("prompt"), role.alias("notebook_path"), text.alias("new_source"))
    tools = F.explode(F.array(*(F.lit(t) for t in ("Edit", "Write", "Bash", "Agent", "NotebookEdit", "Read")))).alias("tool")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(every).alias("p"), tools)
    return rows.select("conv_id", "turn", "tool", F.md5(tx.tool_text(F.col("tool"), F.col("p"))).alias("payload"))


_EVENTS = f"""ev AS (SELECT session_id, tick, text, assistant_message, {_topic("text || ' ' || assistant_message")} AS topic FROM (SELECT conv_id AS session_id, turn AS tick, text, role, lag(role) OVER w AS pr, lag(text) OVER w AS assistant_message FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND pr = 'assistant' AND {_any('text', CORRECTIONS)})"""


@query(f"WITH {_EVENTS} SELECT session_id, tick, topic, md5(text) AS correction, md5(assistant_message) AS answer FROM ev")
def k11_resumed_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Three windows over the messages, each continuing from what the one before carried, give what one pass gives."""
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("tick"), "role", "text")
    carried, every = m.where(F.lit(False)), None
    for window in (m.where("tick < 2"), m.where("tick between 2 and 4"), m.where("tick > 4")):
        events, carried = capture.resume_corrections(window, carried, CORRECTIONS)
        carried = materialize(carried, "carried")
        every = events if every is None else every.unionByName(events)
    return every.select("session_id", "tick", "topic", F.md5("user_correction").alias("correction"), F.md5("assistant_message").alias("answer"))


@query(f"""WITH {_EVENTS}, c AS (SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS id, text, n_chars % 100 AS w, doc_id FROM documents), tp AS (SELECT topic, count(*) AS n FROM ev WHERE topic <> '' GROUP BY topic),
b AS (SELECT doc_id, sum(n) AS n FROM c JOIN tp ON lower(text) LIKE '%' || lower(topic) || '%' GROUP BY doc_id)
SELECT 'doc' AS source, doc_id::VARCHAR AS k, CASE WHEN n > 0 THEN least(100, w + 20 * n) ELSE w END AS signal_weight, NULL AS module FROM c LEFT JOIN b USING (doc_id)
UNION ALL SELECT 'correction_event', sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 100, nullif(topic, '') FROM ev WHERE sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) NOT IN (SELECT id FROM c)
QUALIFY row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY session_id, tick) = 1""")
def k12_apply_corrections(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("tick"), "role", "text")
    events, _ = capture.resume_corrections(m, m.where(F.lit(False)), CORRECTIONS)
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("content"), F.lit("doc").alias("source"), (F.col("n_chars") % 100).cast("int").alias("signal_weight"), tx.content_id(F.col("text")).alias("cid"))
    # Documents repeat contents, so boosts are by key and stored contents by content id.
    out = capture.apply_corrections(chunks.withColumn("id", F.col("k")).drop("cid"), materialize(events, "events"), [])
    stored = chunks.select(F.col("cid").alias("id")).distinct()
    new = capture.not_stored(out.where("source = 'correction_event'"), stored).withColumn("k", F.col("id"))
    return out.where("source = 'doc'").unionByName(new).select("source", "k", "signal_weight", "module")


@query(f"""WITH c AS (SELECT doc_id, text, n_chars % 100 AS w, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND source IN ('src1', 'src2', 'src4', 'src6', 'src7', 'src9', 'src10', 'src12')), f AS (SELECT * FROM c ORDER BY w DESC, doc_id DESC LIMIT 20),
t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM f), s AS (SELECT *, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1)), chr(1))[1] AS fs FROM t), r AS (SELECT *, {_clip('t', 200)} AS title FROM s),
u AS (SELECT title, {_clip('fs', 600)} AS rationale, doc_id::VARCHAR AS date FROM r WHERE t <> '')
SELECT sha256(date || '|' || title)[1:16] AS id, title, rationale, 'pending' AS state FROM u""")
def k13_backfill_decisions(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf).select("id", "content", "source", "signal_weight", "is_decision", F.col("id").alias("ingested_at"), F.col("id").cast("string").alias("date"))
    return capture.backfill_decisions(c, 20, DECIDING)[0].select("id", "title", "rationale", "state")


@query("SELECT count(*) AS matched, greatest(count(*) - 20, 0) AS dropped FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND source IN ('src1', 'src2', 'src4', 'src6', 'src7', 'src9', 'src10', 'src12')")
def k13_backfill_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf).withColumns({"ingested_at": F.col("id"), "date": F.col("id").cast("string")})
    return capture.backfill_decisions(c, 20, DECIDING)[1]


_OUT = f"o AS (SELECT o_orderkey AS id, o_custkey AS thread_id, o_orderdate::DATE::VARCHAR AS date, {_STATE} AS state FROM orders)"


@query(f"""WITH {_OUT}, i AS (SELECT row_number() OVER (ORDER BY n_name) AS p, '- ' || n_name AS line FROM nation WHERE n_regionkey = 1), c AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS p, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 QUALIFY p <= 5),
d AS (SELECT row_number() OVER (ORDER BY date DESC, id) AS p, '- [' || date || '] ' || id AS line FROM o WHERE state = 'confirmed' QUALIFY p <= 20),
n AS (SELECT count(*) FILTER (WHERE state = 'pending' AND id % 2 = 0) AS a, count(*) FILTER (WHERE state = 'pending' AND id % 2 = 1) AS b FROM o),
u AS (SELECT 0 AS part, -1 AS p, '## INVARIANTS' AS line UNION ALL SELECT 0, p, line FROM i UNION ALL SELECT 1, -1, '## RECENT CORRECTIONS' UNION ALL SELECT 1, p, '- ' || {_clip('t', 120)} FROM c
UNION ALL SELECT 2, -1, '## RECENT DECISIONS' UNION ALL SELECT 2, p, line FROM d UNION ALL SELECT 3, 0, 'triage owed: ' || a || ' decisions, ' || b || ' dead ends' FROM n WHERE a + b > 0 UNION ALL SELECT 4, 0, 'health: ok'),
r AS (SELECT row_number() OVER (ORDER BY part, p, line) AS place, line FROM u) SELECT place, line FROM r WHERE place <= 25""")
def k16_session_start(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf).withColumn("date", F.substring("date", 1, 10))

    def placed(rows: DataFrame, *order) -> DataFrame:
        few = rows.orderBy(*order).limit(20)
        return few.select("*", F.posexplode(F.array(F.lit(0))).alias("_p", "_x")).drop("_p", "_x").withColumn("place", F.row_number().over(_window(*order)))

    inv = placed(table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("title")), "title")
    corr = placed(_chunks(spark, sf).where("is_correction").select("id", "content"), F.desc("id")).where("place <= 5")
    dec = placed(o.where("state = 'confirmed'").select("id", "date", F.col("id").cast("string").alias("title")), F.desc("date"), "id")
    debt = o.agg(F.count_if((F.col("state") == "pending") & (F.col("id") % 2 == 0)).alias("decisions"), F.count_if((F.col("state") == "pending") & (F.col("id") % 2 == 1)).alias("dead_ends"))
    return capture.session_start(inv, corr, dec, debt, spark.range(1).select(F.lit("health: ok").alias("line")))


def _window(*order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


@query("""WITH l AS (SELECT doc_id, i AS place, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, place, md5(line) AS line FROM l WHERE place <= 5 UNION ALL SELECT doc_id, 6, md5('(' || (count(*) - 5) || ' more lines)') FROM l GROUP BY doc_id HAVING count(*) > 5""")
def h8_truncated(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("place", F.col("place") + 1)
    return capture.truncate_lines(lines, "doc_id", 5).select("doc_id", "place", F.md5("line").alias("line"))


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 5)::VARCHAR END AS session_id, CASE WHEN event_id % 11 > 0 THEN event_type ELSE '' END AS hash, CASE WHEN value < 50 THEN '' ELSE floor(value / 50)::BIGINT::VARCHAR END AS sig, user_id FROM events WHERE user_id % 10 > 0),
c AS (SELECT user_id, arg_max({'s': session_id, 'h': hash, 'g': sig}, id) AS now, count(*) AS n FROM r GROUP BY user_id),
b AS (SELECT user_id, count(*) AS recent, count(session_id) AS named FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS p FROM r) WHERE p BETWEEN 2 AND 4 GROUP BY user_id),
e AS (SELECT r.user_id, session_id, arg_max(hash, id) AS h, arg_max(sig, id) AS g, max(id) AS id FROM r JOIN c USING (user_id) WHERE session_id IS NOT NULL AND session_id <> now.s GROUP BY r.user_id, session_id),
l AS (SELECT user_id, count(*) AS k, min(h) AS lo, max(h) AS hi, arg_min(g, id) AS g FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS p FROM e) WHERE p <= 2 GROUP BY user_id),
x AS (SELECT u.user_id, n, now, now.s IS NULL AND coalesce(recent, 0) >= 3 AND coalesce(named, 0) = 0 AS off, coalesce(k >= 2 AND lo = hi AND lo = now.h, false) AS same, coalesce(k, 0) AS k, coalesce(g <> '' AND g <> now.g, false) AS moved, n IS NULL OR now.h = '' AS never FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN l USING (user_id))
SELECT user_id, NOT never AND (n = 1 OR NOT off AND NOT (same AND moved)) AS ok, CASE WHEN never THEN 'no render recorded' WHEN n = 1 THEN 'first observation' WHEN off THEN 'guard disarmed' WHEN now.s IS NULL THEN 'session unknown' WHEN k < 2 THEN 'too few sessions' WHEN same AND moved THEN 'render frozen' WHEN same THEN 'corpus idle' ELSE 'render follows corpus' END AS detail FROM x""")
def k19_9_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Users as projects: some were never rendered, some newest renders have no hash, some signatures are empty."""
    e = table(spark, sf, "events")
    sig = F.when(F.col("value") < 50, "").otherwise(F.floor(F.col("value") / 50).cast("string"))
    r = e.where("user_id % 10 > 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 5).cast("string")).alias("session_id"), F.when(F.col("event_id") % 11 > 0, F.col("event_type")).otherwise("").alias("hash"), sig.alias("corpus_sig"), "user_id")
    return health.novelty(r, "user_id", every=e.select("user_id")).select("user_id", "ok", "detail")


@query("""SELECT 'watermark_age' AS name, age <= 259200 AS ok, printf('%.1f days', age / 86400) AS detail FROM (SELECT epoch(TIMESTAMP '2024-02-01') - max(floor(epoch(ts))) AS age FROM events WHERE event_type <> 'view')
UNION ALL SELECT 'module_states', age <= 14, printf('verified %.1f days ago', age) FROM (SELECT (epoch(TIMESTAMP '2024-02-01') - max(floor(epoch(ts)))) / 86400 AS age FROM events WHERE event_type = 'signup')
UNION ALL SELECT 'corpus_age', age <= 21, printf('newest file %.1f days old', age) FROM (SELECT (epoch(TIMESTAMP '2024-02-01') - max(floor(epoch(ts)))) / 86400 AS age FROM events)
UNION ALL SELECT 'not_wired', true, 'not wired'
UNION ALL SELECT 'broken', false, 'check failed: AnalysisException'""")
def k19_age_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of ages over the events' times, one of them broken: it turns red and the others stand."""
    e, now = table(spark, sf, "events"), F.lit(NOW).cast("timestamp")
    value = F.when(F.col("event_type") == "view", F.lit("12345")).otherwise(F.to_json(F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("mtime"))))
    meta = e.select(F.concat(F.lit("incr:"), F.col("event_id").cast("string")).alias("key"), value.alias("value"))
    stamp = e.where("event_type = 'signup'").select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))).alias("text"))
    files = e.select(F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("mtime"))
    checks = {
        "watermark_age": lambda: health.watermark_age(meta, now),
        "module_states": lambda: health.module_states(files, stamp, now),
        "corpus_age": lambda: health.corpus_age(files, now, True),
        "not_wired": lambda: health.corpus_age(files, now, False).withColumn("name", F.lit("not_wired")),
        "broken": lambda: files.select("no_such_column"),
    }
    return health.run_gate(spark, checks).drop("n_red")


@query("""WITH p AS (SELECT page_id // 120 AS project, page_id, '- [' || url || '](p' || page_id || '.md)' AS l FROM pages),
t AS (SELECT project, string_agg(l, chr(10) ORDER BY page_id) AS t, count(*) AS n, min(page_id) % 3 AS k FROM p WHERE page_id % 120 >= project % 3 GROUP BY project),
d AS (SELECT project, n + 2 AS lines, strlen(t) + 18 AS bytes, list_filter([CASE WHEN n + 2 > 119 THEN 'too many lines' END, CASE WHEN strlen(t) + 18 > 90000 THEN 'too many bytes' END, CASE WHEN k = 2 THEN 'anchor missing' WHEN k = 1 THEN 'anchor old' END], lambda x: x IS NOT NULL) AS w FROM t)
SELECT project, 'index_health' AS name, len(w) = 0 AS ok, CASE WHEN len(w) = 0 THEN lines || ' lines, ' || bytes || ' bytes' ELSE array_to_string(w, ', ') END AS detail FROM d""")
def k19_8_index_health(spark: SparkSession, sf: str) -> DataFrame:
    """Each 120 pages' links as a project's index with an anchor below its first line; a third of the linked files is new, a third old, a third not there."""
    p = table(spark, sf, "pages").withColumn("project", F.expr("page_id div 120"))
    lines = p.where("page_id % 120 >= project % 3").select("project", "page_id", F.concat(F.lit("- ["), "url", F.lit("](p"), F.col("page_id").cast("string"), F.lit(".md)")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "l"))), lambda x: x["l"]), "\n")
    text = lines.groupBy("project").agg(F.concat(F.lit("# index\n## LATEST\n"), body).alias("text"))
    old = F.when(F.col("page_id") % 3 == 0, "2024-01-28 00:00:00").otherwise("2024-01-01 00:00:00").cast("timestamp")
    files = p.where("page_id % 3 < 2").select("project", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), old.alias("mtime"))
    return health.index_health(text, files, F.lit(NOW).cast("timestamp"), "## LATEST", 119, by="project")


_U = f"""u AS (SELECT 'session' AS source, text, 0 AS o, conv_id * 1000 + turn AS n, CASE WHEN role = 'user' THEN CASE WHEN {_any('text', CORRECTIONS)} THEN 100 ELSE 10 END ELSE 20 END AS w FROM conversations
UNION ALL SELECT 'doc', text, 1, doc_id, CASE WHEN n_chars % 100 >= 50 THEN 50 ELSE 20 END FROM documents UNION ALL SELECT 'memory', text, 2, item_id, 20 FROM benchmark
UNION ALL SELECT 'experiment_summary', p_name, 3, p_partkey, 20 FROM part UNION ALL SELECT 'git', c_name || chr(10) || chr(10) || c_custkey, 4, c_custkey, 20 FROM customer),
f AS (SELECT *, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS id FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, n) = 1)"""


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    weight = F.when(F.col("role") == "user", F.when(tx.phrase_any(F.col("text"), CORRECTIONS), 100).otherwise(10)).otherwise(20)
    own = [
        (c.select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "role"), "session", weight),
        (table(spark, sf, "documents").select("text", F.col("doc_id").alias("n"), "n_chars"), "doc", F.when(F.col("n_chars") % 100 >= 50, 50).otherwise(20)),
        (table(spark, sf, "benchmark").select("text", F.col("item_id").alias("n")), "memory", F.lit(20)),
        (table(spark, sf, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("n")), "experiment_summary", F.lit(20)),
        (table(spark, sf, "customer").select(F.concat_ws("\n\n", "c_name", F.col("c_custkey").cast("string")).alias("text"), F.col("c_custkey").alias("n")), "git", F.lit(20)),
    ]
    parts = [readers.to_chunks(rows, name, w).select("source", F.col("text").alias("content"), "n", F.lit(i).alias("o"), F.col("signal_weight").cast("int").alias("signal_weight")) for i, (rows, name, w) in enumerate(own)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_U} SELECT id, source, w AS signal_weight, n FROM f")
def a9_five_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All five sources in their order; of equal contents the first source's row is kept."""
    return capture.first_by_content(_sources(spark, sf), "content", ["o", "n"]).select("id", "source", "signal_weight", "n")


@query(f"WITH {_U} SELECT id, CASE WHEN n % 7 = 0 THEN 'embed_fail' END AS action, CASE WHEN n % 7 = 0 THEN 'timeout' END AS detail FROM f WHERE NOT (source = 'doc' AND n % 2 = 0) AND id NOT IN (SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM documents WHERE doc_id % 2 = 0)")
def a10_insert_log(spark: SparkSession, sf: str) -> DataFrame:
    """New rows of the five sources beside a store that has every second document; some embeddings fail."""
    rows = _sources(spark, sf)
    stored = table(spark, sf, "documents").where("doc_id % 2 = 0").select(tx.content_id(F.col("text")).alias("id"))
    first = capture.first_by_content(rows, "content", ["o", "n"])
    fails = F.when(F.col("n") % 7 == 0, "timeout")
    embedded = first.select("id", F.when(fails.isNull(), F.array(F.lit(1.0))).alias("embedding"), fails.alias("embed_error"))
    return capture.insert_chunks(stored, rows, ["o", "n"], embedded)[1].select("id", "action", "detail")


@query("SELECT item_id AS prompt_id, sha256(text) AS prompt_hash, text[1:200] AS prompt_truncated, '[\"' || (item_id % 3) || '\"]' AS topics_json FROM benchmark")
def n1_invocations(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"), F.array((F.col("item_id") % 3).cast("string")).alias("topics"))
    return telemetry.invocation_rows(b, F.lit(NOW)).drop("ts")


@query("SELECT event_id, event_type AS hook, CASE WHEN value > 90 THEN 0 ELSE 1 END AS ok, CASE WHEN value > 90 THEN props[1:500] END AS detail FROM events")
def n2_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("error", F.when(F.col("value") > 90, F.coalesce("props", F.lit("")))).withColumn("hook", F.struct("event_id", "event_type"))
    rows = telemetry.heartbeat_rows(e, F.lit(NOW))
    return rows.select("hook.event_id", F.col("hook.event_type").alias("hook"), "ok", "detail")


@query("SELECT event_type AS component, CASE WHEN max(value) > 400 THEN 'FAIL' WHEN avg(value) > 20 THEN 'WARN' ELSE 'OK' END AS status FROM events GROUP BY event_type")
def n4_components(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "events").groupBy(F.col("event_type").alias("component")).agg(F.avg("value").alias("latency_ms"), F.when(F.max("value") > 400, "too large").alias("error"))
    return telemetry.component_rows(probes, F.lit(NOW), 20).select("component", "status")


# Each second outcome is superseded and then attached to the next customer's thread, or confirmed; the change before that said the opposite.
_CHANGES = f"""{_OUT}, c AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'attach' WHEN id % 5 = 0 THEN 'supersede' WHEN id % 3 = 0 THEN 'confirm' ELSE 'reject' END AS op, thread_id, thread_id + 1 AS t, (thread_id + 1) IN (SELECT thread_id FROM o) AS there FROM o WHERE id % 2 = 1)"""


@query(f"""WITH {_CHANGES} SELECT o.id, CASE WHEN op = 'attach' AND there THEN t ELSE o.thread_id END AS thread_id, CASE WHEN op = 'attach' AND there THEN 'new ' || o.id ELSE 'title ' || o.id END AS title, CASE op WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE state END AS state,
CASE WHEN op = 'supersede' THEN 'new ' || o.id WHEN op = 'attach' THEN 'old ' || o.id END AS superseded_by, CASE WHEN op = 'confirm' THEN o.id % 9 > 0 END AS approved FROM o LEFT JOIN c USING (id)""")
def j6_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)[0]


@query(f"""WITH {_CHANGES}, m AS (SELECT t, max(id) AS b FROM (SELECT t, id FROM c WHERE op = 'attach' AND there UNION ALL SELECT thread_id, id - 1 FROM c WHERE op = 'attach' UNION ALL SELECT thread_id, id FROM c WHERE op = 'supersede' UNION ALL SELECT c_custkey, c_custkey + 50 FROM customer WHERE c_custkey % 4 = 0) GROUP BY t)
SELECT DISTINCT o.thread_id, greatest(100, coalesce(b, 0)) AS last_updated, CASE WHEN o.thread_id % 4 = 0 THEN 'summary of ' || c_name ELSE 'none' END AS summary FROM o LEFT JOIN m ON m.t = o.thread_id LEFT JOIN customer ON c_custkey = o.thread_id""")
def j6_threads(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)[1]


def _changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = _outcomes(spark, sf)
    rows = o.select("id", "thread_id", F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), "state")
    op = F.when(F.col("id") % 7 == 0, "attach").when(F.col("id") % 5 == 0, "supersede").when(F.col("id") % 3 == 0, "confirm").otherwise("reject")
    named = F.when(op == "confirm", F.when(F.col("id") % 9 > 0, "true").otherwise("false")).otherwise(F.concat(F.lit("new "), F.col("id").cast("string")))
    last = o.where("id % 2 = 1").select(F.lit(2).alias("seq"), "id", op.alias("op"), named.alias("value"), F.when(op == "attach", F.col("thread_id") + 1).alias("thread_id"), F.col("id").alias("ts"))
    opposite = F.when(F.col("op") == "confirm", "reject").when(F.col("op") == "reject", "confirm").otherwise("supersede")
    earlier = last.where("op <> 'supersede'").select(F.lit(1).alias("seq"), "id", opposite.alias("op"), F.when(F.col("op") == "attach", F.concat(F.lit("old "), F.col("id").cast("string"))).alias("value"), F.lit(None).cast("bigint").alias("thread_id"), (F.col("ts") - 1).alias("ts"))
    unknown = last.withColumn("id", -F.col("id")).limit(5)
    told = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.lit(3).alias("seq"), F.lit(None).cast("bigint").alias("id"), F.lit("summarize").alias("op"), F.concat(F.lit("summary of "), "c_name").alias("value"), F.col("c_custkey").cast("bigint").alias("thread_id"), (F.col("c_custkey") + 50).cast("bigint").alias("ts"))
    threads = o.select("thread_id").distinct().withColumn("last_updated", F.lit(100).cast("bigint")).withColumn("summary", F.lit("none"))
    return capture.outcomes_now(rows, last.unionByName(earlier).unionByName(unknown).unionByName(told), threads)


@query("SELECT count(*) FILTER (WHERE page_id % 2 = 0) AS scanned, count(*) FILTER (WHERE page_id % 2 = 0 AND regexp_matches(lower(string_split(url, '/')[-1]), '^(p|a)')) AS matched, count(*) FILTER (WHERE page_id % 2 = 0 AND page_id % 3 > 0 AND regexp_matches(lower(string_split(url, '/')[-1]), '^(p|a)')) AS retagged, count(*) FILTER (WHERE page_id % 6 = 0 AND regexp_matches(lower(string_split(url, '/')[-1]), '^(p|a)')) AS already_tagged FROM pages")
def j9_retag(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("file_path"), F.when(F.col("page_id") % 2 == 0, "memory").otherwise("doc").alias("source"), (F.col("page_id") % 3 == 0).alias("is_correction"))
    return capture.retag_corrections(p, ["p", "a"])[1]


@query("SELECT doc_id, lang, NULL::BIGINT AS access_count FROM documents")
def j10_migrated(spark: SparkSession, sf: str) -> DataFrame:
    return capture.migrate(table(spark, sf, "documents").select("doc_id", "lang"), {"lang": "int", "access_count": "bigint"})


@query("SELECT url || '#' || page_id AS path, 'read_fail' AS action, CASE WHEN page_id % 10 = 0 THEN 'gone' ELSE 'not read' END AS detail FROM pages WHERE page_id % 5 = 0")
def l9_read_failures(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.concat_ws("#", "url", "page_id").alias("path"), F.col("html").alias("text"), "page_id")
    read = p.where("page_id % 5 > 0 or page_id % 10 = 0").select("path", F.when(F.col("page_id") % 5 > 0, F.col("text")).alias("text"), F.when(F.col("page_id") % 10 == 0, "gone").alias("error"))
    return readers.read_failures(p, read, F.lit(NOW)).drop("ts")


@query("""WITH s AS (SELECT count(*) AS invocations, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
t AS (SELECT event_type AS topic, count(*) AS n, min(event_id) AS f FROM events GROUP BY event_type), c AS (SELECT event_type AS component, bool_or(value > 400) AS warn FROM events GROUP BY event_type)
SELECT 0 AS section, 0 AS place, '- invocations: ' || invocations AS line FROM s UNION ALL SELECT 0, 1, '- errors: ' || errors FROM s
UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, f, topic), '- ' || topic || ': ' || n FROM t UNION ALL SELECT 2, row_number() OVER (ORDER BY component), '- ' || component || CASE WHEN warn THEN ' WARN' ELSE '' END FROM c""")
def a12_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    summary = telemetry.weekly_summary(e.crossJoin(e.agg(F.max("ts").alias("now"))), F.col("now"), {"errors": F.col("event_type") == "error"})
    topics = telemetry.top_topics(e.withColumn("topics", F.to_json(F.array("event_type"))), "topics", "event_id")
    statuses = e.groupBy(F.col("event_type").alias("component")).agg(F.bool_or(F.col("value") > 400).alias("warn"))
    return telemetry.report_lines(summary, topics, statuses)


@query(f"""WITH {_OUT}, t AS (SELECT c_custkey AS thread_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'open' ELSE 'closed' END AS state, c_acctbal AS u FROM customer), f AS (SELECT *, row_number() OVER (ORDER BY u DESC, thread_id) AS place FROM t WHERE state = 'open' QUALIFY place <= 20)
SELECT place, thread_id, name, (SELECT count(*) FROM o WHERE o.thread_id = f.thread_id) AS n_outcomes FROM f""")
def k18_open_threads(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("thread_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "open").otherwise("closed").alias("state"), F.col("c_acctbal").alias("last_updated"))
    return capture.open_threads(t, _outcomes(spark, sf))


@query("""WITH i AS (SELECT count(*) AS n, sum(strlen(url)) AS b FROM pages), s AS (SELECT p_brand AS title, count(*) AS n FROM part GROUP BY p_brand), l AS (SELECT url AS link, count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1),
o AS (SELECT p_name || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45))
SELECT 0 AS part, 0 AS place, 'budget: ' || n || ' lines (max 20), ' || b || ' bytes (max 90000)' || CASE WHEN n > 20 OR b > 90000 THEN ' OVER' ELSE ' OK' END AS line FROM i
UNION ALL SELECT 1, row_number() OVER (ORDER BY s.n DESC, title) AS p, s.n || ' lines  ' || title FROM s, i WHERE i.n > 20 OR b > 90000 QUALIFY p <= 5
UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, link) AS p, link || ' (x' || n || ')' FROM l QUALIFY p <= 20
UNION ALL SELECT 3, 0, 'not linked: ' || count(*) || ' files' FROM o UNION ALL SELECT 3, row_number() OVER (ORDER BY name) AS p, name FROM o QUALIFY p <= 20
UNION ALL SELECT 3, 21, 'and ' || (count(*) - 20) || ' more' FROM o HAVING count(*) > 20""")
def k20_budget_report(spark: SparkSession, sf: str) -> DataFrame:
    pages, part = table(spark, sf, "pages"), table(spark, sf, "part")
    index = pages.agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("url")).alias("n_bytes"))
    linked = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    orphans = part.join(linked, "p_partkey", "left_anti").select(F.concat(F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"))
    return health.budget_report(index, part.groupBy(F.col("p_brand").alias("title")).agg(F.count("*").alias("n_lines")), pages.groupBy(F.col("url").alias("link")).agg(F.count("*").alias("n")), orphans, 20)


@query("SELECT 'health_gate' AS hook, 1 AS ok, 'red: ' || string_agg(event_type, ', ' ORDER BY event_type) AS detail FROM (SELECT event_type FROM events GROUP BY event_type HAVING max(value) > 300)")
def n5_self_heartbeat(spark: SparkSession, sf: str) -> DataFrame:
    checks = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg((F.max("value") <= 300).alias("ok"))
    return health.self_heartbeat(checks, F.lit(NOW)).drop("ts")


@query("SELECT CASE WHEN turn % 2 = 0 THEN conv_id || '' ELSE 'log-' || conv_id END AS session_id, role AS tool, md5(text) AS prompt, true AS ok FROM conversations UNION ALL SELECT NULL, NULL, NULL, false FROM conversations WHERE turn = 0")
def a14_hook_events(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads written as JSON lines, every second without a session id, and a broken line for each conversation."""
    path = scratch_path(spark, "payloads")
    c = table(spark, sf, "conversations")
    sid = F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).otherwise("")
    good = F.to_json(F.struct(sid.alias("session_id"), F.concat(F.lit("/logs/log-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("transcript_path"), F.col("role").alias("tool_name"), F.col("text").alias("prompt")))
    c.select(good.alias("value")).unionByName(c.where("turn = 0").select(F.lit('{"session_id": ').alias("value"))).write.text(path)
    return readers.hook_events(spark, path).select("session_id", "tool", F.md5("prompt").alias("prompt"), "ok")
