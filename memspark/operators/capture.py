"""Capture state: candidates and corrections mined from conversations, threads and their outcomes.

State tables are append-only event frames; the current state is the latest event of each key, so
upserts, counters and confirmations are aggregations and never rewrite rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.functions import classify, lexicon
from memspark.functions.text import clip, content_id, derive_aliases, extract_topic, first_sentence, phrase_any, sections, sentences, short_id
from memspark.operators.patterns import matches
from memspark.operators.ranks import placed


def first_by_content(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each distinct content, with its content id."""
    own = rows.withColumn("id", content_id(F.col(text)))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_r = 1").drop("_r")


def not_stored(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, chunk_id: str, vector_id: str) -> DataFrame:
    """Chunks without a vector: a hashed anti-join."""
    return chunks.join(vectors.select(F.col(vector_id).alias(chunk_id)), chunk_id, "left_anti")


def correction_events(messages: DataFrame, phrases: list[str] = lexicon.CORRECTION_PHRASES, session: str = "session_id", pos: str = "pos", role: str = "role", text: str = "text", skip_harness: bool = True) -> DataFrame:
    """(session, pos, topic, user_correction, assistant_message) of a person's message right after an answer.

    Rows without text don't come between; a harness row doesn't fire but is the row before the next.
    """
    w = Window.partitionBy(session).orderBy(pos)
    rows = messages.where(F.col(text).isNotNull()).withColumn("_role", F.lag(role).over(w)).withColumn("_text", F.lag(text).over(w))
    fires = (F.col(role) == "user") & (F.col("_role") == "assistant") & phrase_any(F.col(text), phrases)
    if skip_harness:
        fires = fires & classify.harness_reason(F.col(text)).isNull()
    topic = extract_topic(F.concat_ws(" ", text, "_text"))
    return rows.where(fires).select(session, pos, topic.alias("topic"), F.col(text).alias("user_correction"), F.col("_text").alias("assistant_message"))


def candidates(messages: DataFrame, decision_cues: list[str] = lexicon.DECISION_CUES, dead_end_cues: list[str] = lexicon.DEAD_END_CUES, session: str = "session_id", pos: str = "pos", text: str = "text", shortest: int = 40, cap: int = 25, title_chars: int = 200, rationale_chars: int = 600) -> DataFrame:
    """(session, kind, title, rationale, pos, place): sentences with a cue of a decision or dead end.

    Harness and maintenance records are skipped; echoes and fragments are gated out; each title
    enters once for a session and kind, and the first ``cap`` stay.
    """
    rows = messages.where(F.col(text).isNotNull() & classify.harness_reason(F.col(text)).isNull() & ~classify.is_maintenance(F.col(text)))
    each = rows.select(session, pos, F.posexplode(sentences(F.col(text))).alias("s", "sentence"))
    kinds = F.array(F.when(phrase_any(F.col("sentence"), decision_cues), "decision"), F.when(phrase_any(F.col("sentence"), dead_end_cues), "dead_end"))
    each = each.withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    each = each.select(session, pos, "s", "kind", clip(F.col("sentence"), title_chars).alias("title"), F.substring("sentence", 1, rationale_chars).alias("rationale"))
    each = each.where(classify.gate_reason(F.col("title"), shortest).isNull())
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(session, "kind", "title").orderBy(pos, "s"))).where("_r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(session, "kind").orderBy(pos, "s"))).where(F.col("place") <= cap).drop("_r", "s")


def scan_skips(messages: DataFrame, cues: list[str], text: str = "text", shortest: int = 40) -> DataFrame:
    """One row of counters: harness, maintenance, echoes, fragments and kept sentences."""
    harness, upkeep = classify.harness_reason(F.col(text)).isNotNull(), classify.is_maintenance(F.col(text))
    usable = messages.where(F.col(text).isNotNull())
    skipped = usable.agg(F.count_if(harness).alias("harness"), F.count_if(~harness & upkeep).alias("maintenance"))
    titles = usable.where(~harness & ~upkeep).select(F.explode(F.filter(sentences(F.col(text)), lambda s: phrase_any(s, cues))).alias("s")).select(classify.gate_reason(clip(F.col("s"), 200), shortest).alias("why"))
    return skipped.crossJoin(titles.agg(F.count_if(F.col("why") == "status_echo").alias("status_echo"), F.count_if(F.col("why") == "too_short").alias("too_short"), F.count_if(F.col("why").isNull()).alias("kept")))


def topic_boost(chunks: DataFrame, topics: DataFrame, text: str, weight: str, step: int = 20, most: int = 100, exempt: Column | None = None) -> DataFrame:
    """Weights raised by ``step`` for each topic that a chunk contains (LIKE, any case), at most ``most``.

    ``topics`` (topic), with repeats; ``_`` in a topic matches any character. All topics are looked
    for in one pass over the texts.
    """
    raised = F.least(F.lit(most), F.col(weight) + step * F.col("n_boosts"))
    asked = topics.where("topic <> ''").groupBy(F.col("topic").alias("pattern")).agg(F.count("*").alias("times"))  # a topic may come several times
    own = chunks.where(~exempt) if exempt is not None else chunks
    met = matches(own, asked, "id", text).join(asked, "pattern").groupBy("id").agg(F.sum("times").alias("n_boosts"))
    out = chunks.join(met, "id", "left").withColumn("n_boosts", F.coalesce("n_boosts", F.lit(0)))
    return out.withColumn("boosted", F.when(F.col("n_boosts") > 0, raised).otherwise(F.col(weight)))


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest event of each key (upsert by appending)."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_or_ignore(events: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def counters(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("delivery_count"), F.max(ts).alias("last_delivered"))


def lineage_lines(outcomes: DataFrame, thread_id: str, order: list[str], line: str) -> DataFrame:
    """(thread_id, place, n, line) of each outcome: its place in its thread from 1, and the thread's number of lines."""
    lines = placed(outcomes.select(thread_id, *order, line), [thread_id], list(order))
    return lines.join(outcomes.groupBy(thread_id).agg(F.count("*").alias("n")), thread_id).select(thread_id, "place", "n", line)


def thread_lineage(threads: DataFrame, outcomes: DataFrame, thread_id: str, order: list[str], title: str) -> DataFrame:
    """Each thread with its number of outcomes, once for each of them: ``place`` (oldest first, from 1) and title; a thread without any is one row.

    A thread may hold any part of all outcomes: places come from :func:`ranks.placed`.
    """
    counts = outcomes.groupBy(thread_id).agg(F.count("*").alias("n_outcomes"))
    lines = placed(outcomes.select(thread_id, *order, title), [thread_id], list(order)).select(thread_id, "place", title)
    return threads.join(counts, thread_id, "left").join(lines, thread_id, "left").withColumn("n_outcomes", F.coalesce("n_outcomes", F.lit(0)))


def open_threads(threads: DataFrame, outcomes: DataFrame, most: int = 20) -> DataFrame:
    """(place, thread_id, name, n_outcomes): open threads (thread_id, name, state, last_updated), the newest first, at most ``most``."""
    few = threads.where("state = 'open'").orderBy(F.desc("last_updated"), "thread_id").limit(most)
    counts = outcomes.join(few.select("thread_id"), "thread_id", "left_semi").groupBy("thread_id").agg(F.count("*").alias("n_outcomes"))
    rows = few.join(counts, "thread_id", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_updated"), "thread_id")))
    return rows.select("place", "thread_id", "name", F.coalesce("n_outcomes", F.lit(0)).alias("n_outcomes"))


def stale_lineage(threads: DataFrame, key: str, updated: str) -> DataFrame:
    """Threads whose cached lineage has another key than their last update."""
    return threads.where(F.coalesce(key, F.lit("")) != F.coalesce(updated, F.lit("")))


def triage(verdicts: DataFrame, decisions: DataFrame, dead_ends: DataFrame) -> DataFrame:
    """(id, kind, verdict, thread_id, new_thread, state) of each verdict (id, verdict, thread).

    An id is looked up among decisions, then dead ends; ``new:name`` opens a thread; unknown ids
    have a null kind and state.
    """
    d = decisions.select("id").distinct().withColumn("d", F.lit(True))
    e = dead_ends.select("id").distinct().withColumn("e", F.lit(True))
    kind = F.when(F.col("d"), "decision").when(F.col("e"), "dead_end")
    rows = verdicts.join(d, "id", "left").join(e, "id", "left").withColumn("kind", kind)
    opens = F.col("thread").startswith("new:")
    name = F.when(opens, F.substring("thread", 5, 1000)).otherwise(F.col("thread"))
    state = F.when(F.col("kind").isNotNull(), F.when(F.col("verdict") == "confirm", "confirmed").when(F.col("verdict") == "reject", "rejected").otherwise("pending"))
    return rows.select("id", "kind", "verdict", F.when(opens, F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "-"))).otherwise(name).alias("thread_id"), F.coalesce(opens, F.lit(False)).alias("new_thread"), state.alias("state"))


def regrade(chunks: DataFrame, module: Column, path_module: Column) -> DataFrame:
    """Re-graded chunks (id, content, role, is_correction, is_decision, signal_weight, module) and what changed.

    Clears corrections that no person made, demotes harness text, fills modules that lack. ``lowered``
    are the demoted rows that weren't at the bottom yet, ``changed`` those that any rule changed.
    """
    harness = classify.harness_reason(F.col("content")).isNotNull()
    cleared = F.coalesce(F.col("is_correction"), F.lit(False)) & (F.coalesce(F.col("role"), F.lit("")) != "user")
    filled = F.when(F.col("module").isNull(), F.coalesce(module, path_module)).otherwise(F.col("module"))
    low = F.coalesce((F.col("signal_weight") == 0) & (~F.col("is_correction") | cleared) & ~F.col("is_decision"), F.lit(False))
    out = chunks.withColumn("cleared", cleared).withColumn("demoted", harness).withColumn("lowered", harness & ~low).withColumn("new_module", filled)
    out = out.withColumn("is_correction", F.when(harness | cleared, False).otherwise(F.col("is_correction"))).withColumn("is_decision", F.when(harness, False).otherwise(F.col("is_decision")))
    out = out.withColumn("signal_weight", F.when(harness, 0).otherwise(F.col("signal_weight")))
    out = out.withColumn("filled", F.col("module").isNull() & F.col("new_module").isNotNull()).withColumn("module", F.col("new_module")).drop("new_module")
    return out.withColumn("changed", F.col("cleared") | F.col("lowered") | F.col("filled"))


def regrade_counts(regraded: DataFrame) -> DataFrame:
    """(source, cleared, demoted, filled, unchanged) of re-graded chunks for each source ('' for none), and under a null source for all."""
    counts = [F.count_if("cleared").alias("cleared"), F.count_if("lowered").alias("demoted"), F.count_if("filled").alias("filled"), F.count_if(~F.col("changed")).alias("unchanged")]
    return regraded.withColumn("source", F.coalesce("source", F.lit(""))).rollup("source").agg(*counts)


def save_version(chunks: DataFrame, folder: str, suffix: str) -> str:
    """Write a version of a table beside the others; one that exists is never overwritten."""
    path = f"{folder}.{suffix}"
    chunks.write.mode("errorifexists").parquet(path)
    return path


def rotation(chunks: DataFrame, keep: Column, k: int) -> DataFrame:
    """The k genuine rows that were shown longest ago: never shown first, then newest."""
    return chunks.where(keep).orderBy(F.asc_nulls_first("last_accessed"), F.desc("ingested_at"), "id").limit(k)


def prune_candidates(chunks: DataFrame, now: Column, min_age_days: int = 30, k: int = 50) -> DataFrame:
    """Chunks never shown and old enough, oldest first; dates that can't be read are left alone."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp("ingested_at"))) / 86400)
    return chunks.withColumn("age_days", age).where((F.col("access_count") == 0) & (F.col("age_days") >= min_age_days)).orderBy("ingested_at", "id").limit(k)


def outcome_id(date: Column, title: Column) -> Column:
    return short_id(date, title)


def resume_corrections(window: DataFrame, carried: DataFrame, phrases: list[str] = lexicon.CORRECTION_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(events, carried for the next window) of newly appended messages (session_id, tick, role, text).

    ``tick`` is the byte offset of a record. ``carried`` has the last message with text of each
    session so far; it only gives context and fires nothing, so windows give what one pass gives.
    """
    own = window.select("session_id", "tick", "role", "text", F.lit(True).alias("fresh"))
    both = own.unionByName(carried.select("session_id", "tick", "role", "text").withColumn("fresh", F.lit(False))).where("text is not null")
    w = Window.partitionBy("session_id").orderBy("tick")
    rows = both.withColumn("_role", F.lag("role").over(w)).withColumn("_text", F.lag("text").over(w))
    fires = F.col("fresh") & (F.col("role") == "user") & (F.col("_role") == "assistant") & phrase_any(F.col("text"), phrases) & classify.harness_reason(F.col("text")).isNull()
    events = rows.where(fires).select("session_id", "tick", extract_topic(F.concat_ws(" ", "text", "_text")).alias("topic"), F.col("text").alias("user_correction"), F.col("_text").alias("assistant_message"))
    last = both.groupBy("session_id").agg(F.max_by(F.struct("tick", "role", "text"), "tick").alias("x")).select("session_id", "x.*")
    return events, last


def apply_corrections(chunks: DataFrame, events: DataFrame, acronyms: list = lexicon.ACRONYMS, step: int = 20) -> DataFrame:
    """Chunks (id, content, source, role, session_id, module, aliases, signal_weight, is_correction) with the events' own.

    Each event's correction becomes a chunk of weight 100 under its topic, unless its content is
    stored, and each event with a topic raises the chunks that contain it, other corrections aside.
    """
    own = F.col("source") == "correction_event"
    boosted = topic_boost(chunks, events.select("topic"), "content", "signal_weight", step, exempt=own)
    kept = boosted.withColumn("signal_weight", F.col("boosted")).drop("boosted", "n_boosts")
    new = events.select(F.col("user_correction").alias("content"), F.lit("correction_event").alias("source"), F.lit("user").alias("role"), "session_id", F.nullif("topic", F.lit("")).alias("module"), derive_aliases(F.col("user_correction"), acronyms).alias("aliases"), F.lit(100).alias("signal_weight"), F.lit(True).alias("is_correction"), "tick")
    new = first_by_content(new, "content", ["session_id", "tick"]).drop("tick")
    return kept.unionByName(not_stored(new, chunks), allowMissingColumns=True)


def insert_chunks(stored: DataFrame, rows: DataFrame, order: list[str], embedded: DataFrame | None = None, ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, log): rows (content, ...) that aren't stored yet, the first of each content, and a log row for each.

    With ``embedded`` (id, embedding, embed_error) new rows get their vector and a failed one is
    logged as ``embed_fail``; it is stored all the same.
    """
    new = not_stored(first_by_content(rows, "content", order), stored)
    if embedded is not None:
        new = new.join(embedded.select("id", "embedding", "embed_error"), "id", "left")
    error = F.col("embed_error") if embedded is not None else F.lit(None).cast("string")
    log = new.select((ts if ts is not None else F.current_timestamp()).alias("ts"), "id", F.when(error.isNotNull(), "embed_fail").alias("action"), F.substring(error, 1, 500).alias("detail"))
    return new, log


def backfill_decisions(chunks: DataFrame, limit: int, sources: tuple[str, ...] = ("doc", "memory")) -> tuple[DataFrame, DataFrame]:
    """(pending decisions, counts) from chunks that are tagged as decisions, the heaviest and newest first.

    Decisions (id, title, date, rationale, state); of equal ids the heaviest and newest. Counts (matched, dropped).
    """
    own = chunks.where(F.col("is_decision") & F.col("source").isin(*sources))
    counts = own.agg(F.count("*").alias("matched"), F.greatest(F.count("*") - limit, F.lit(0)).alias("dropped"))
    few = own.orderBy(F.desc("signal_weight"), F.desc("ingested_at"), "id").limit(limit)
    title = clip(F.coalesce("content", F.lit("")), 200)
    rows = few.select("date", title.alias("title"), clip(first_sentence(F.coalesce("content", F.lit(""))), 600).alias("rationale"), "signal_weight", "ingested_at", F.col("id").alias("_id")).where("title <> ''")
    rows = rows.withColumn("id", outcome_id(F.coalesce("date", F.lit("")), F.col("title")))
    return insert_or_ignore(rows, ["id"], [F.desc("signal_weight"), F.desc("ingested_at"), "_id"]).select("id", "title", "date", "rationale", F.lit("pending").alias("state")), counts


def outcomes_now(rows: DataFrame, changes: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, threads) after appended changes (seq, id, op, value, thread_id, ts).

    Ops on outcomes: confirm (a value of true or false says whether it was approved), reject, attach
    (to an existing thread; with a value the title too), retitle, supersede; on threads: summarize
    (thread_id, value). The latest change of each kind wins. Attaching moves the thread's
    last_updated to the change's ``ts``, summarizing the same, superseding that of the thread which
    owned the outcome at that time. Changes of unknown ids, and attachments to unknown threads, change nothing.
    """
    known = changes.where("op <> 'summarize'").join(rows.select("id", F.col("thread_id").alias("_first")).distinct(), "id")
    there = threads.select("thread_id").distinct().withColumn("there", F.lit(True))
    known = known.join(there, "thread_id", "left").where("op <> 'attach' or there").drop("there")

    def last(ops: list[str], what: str) -> Column:
        hit = F.col("op").isin(ops) & F.col(what).isNotNull() if what != "op" else F.col("op").isin(ops)
        return F.max_by(F.when(hit, F.col(what)), F.when(hit, F.col("seq")))

    now = known.groupBy("id").agg(last(["confirm", "reject"], "op").alias("verdict"), last(["attach"], "thread_id").alias("to"), last(["attach", "retitle"], "value").alias("name"), last(["supersede"], "value").alias("by"), last(["confirm"], "value").alias("yes"))
    out = rows.join(now, "id", "left")
    state = F.when(F.col("verdict") == "confirm", "confirmed").when(F.col("verdict") == "reject", "rejected").otherwise(F.col("state"))
    approved = F.coalesce(F.expr("try_cast(yes as boolean)"), F.col("approved") if "approved" in rows.columns else F.lit(None).cast("boolean"))
    out = out.select("id", F.coalesce("to", "thread_id").alias("thread_id"), F.coalesce("name", "title").alias("title"), state.alias("state"), F.col("by").alias("superseded_by"), approved.alias("approved"))
    earlier = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.coalesce(F.last(F.when(F.col("op") == "attach", F.col("thread_id")), ignorenulls=True).over(earlier), F.col("_first"))
    touched = known.withColumn("_owner", owner).where("op in ('attach', 'supersede')").select(F.when(F.col("op") == "attach", F.col("thread_id")).otherwise(F.col("_owner")).alias("thread_id"), "ts")
    told = changes.where("op = 'summarize'").select("thread_id", "seq", "ts", "value")
    moved = touched.unionByName(told.select("thread_id", "ts")).where("thread_id is not null").groupBy("thread_id").agg(F.max("ts").alias("bumped"))
    summaries = told.groupBy("thread_id").agg(F.max_by("value", "seq").alias("_told"))
    after = threads.join(moved, "thread_id", "left").join(summaries, "thread_id", "left").withColumn("last_updated", F.greatest("last_updated", "bumped"))
    summary = F.coalesce("_told", F.col("summary") if "summary" in threads.columns else F.lit(None).cast("string"))
    return out, after.withColumn("summary", summary).drop("bumped", "_told")


def retag_corrections(chunks: DataFrame, prefixes: list[str] = lexicon.CURATED_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """(chunks, counts): memory chunks of curated files are corrections; (scanned, matched, retagged, already_tagged)."""
    scanned = F.coalesce(F.col("source") == "memory", F.lit(False))
    matched = scanned & F.coalesce(classify.is_curated_correction(F.col("file_path"), prefixes), F.lit(False))
    tagged = F.coalesce("is_correction", F.lit(False))
    counts = chunks.agg(F.count_if(scanned).alias("scanned"), F.count_if(matched).alias("matched"), F.count_if(matched & ~tagged).alias("retagged"), F.count_if(matched & tagged).alias("already_tagged"))
    return chunks.withColumn("is_correction", tagged | matched), counts


def migrate(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with the columns (name: type) that an older table lacks, as nulls; existing ones keep type and values."""
    return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in rows.columns))


def archive_sections(docs: DataFrame, id_col: str, text_col: str, mark: Column, heading: str) -> tuple[DataFrame, DataFrame]:
    """(kept, moved): sections (id, section, raw) below headings whose mark holds go to the archive, newest (last) first."""
    rows = sections(docs, id_col, text_col, heading).withColumn("_moved", F.coalesce(mark, F.lit(False)) & (F.col("section") > 0))
    kept = rows.where("not _moved").drop("_moved", "first")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("section")))
    return kept, rows.where("_moved").withColumn("place", place).drop("_moved", "first")


def session_start(invariants: DataFrame, corrections: DataFrame, decisions: DataFrame, debt: DataFrame, health: DataFrame, most: int = 25, chars: int = 120) -> DataFrame:
    """(place, line): what a session is shown first, as ordered lines, the first ``most``.

    ``invariants`` (place, title), ``corrections`` (place, content), ``decisions`` (place, date,
    title), ``debt`` (decisions, dead_ends) pending, ``health`` (line): all of them short lists. A
    list without rows says so; no debt, no line.
    """
    spark = invariants.sparkSession
    parts = [
        ("INVARIANTS", invariants.select("place", F.concat(F.lit("- "), "title").alias("line"))),
        ("RECENT CORRECTIONS", corrections.select("place", F.concat(F.lit("- "), clip(F.col("content"), chars)).alias("line"))),
        ("RECENT DECISIONS", decisions.select("place", F.concat(F.lit("- ["), F.col("date"), F.lit("] "), F.col("title")).alias("line"))),
    ]
    out = None
    for i, (title, rows) in enumerate(parts):
        head = spark.createDataFrame([(i, -1, f"## {title}")], "part int, place int, line string")
        empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(i).alias("part"), F.lit(0).alias("place"), F.lit("- (none recorded)").alias("line"))
        body = head.unionByName(rows.select(F.lit(i).alias("part"), F.col("place").cast("int").alias("place"), "line")).unionByName(empty)
        out = body if out is None else out.unionByName(body)
    owed = debt.where("decisions > 0 or dead_ends > 0").select(F.lit(3).alias("part"), F.lit(0).alias("place"), F.format_string("triage owed: %d decisions, %d dead ends", "decisions", "dead_ends").alias("line"))
    out = out.unionByName(owed).unionByName(health.select(F.lit(4).alias("part"), F.lit(0).alias("place"), "line"))
    ranked = out.where(F.trim("line") != "").withColumn("n", F.row_number().over(Window.orderBy("part", "place", "line")))
    return ranked.where(F.col("n") <= most).select(F.col("n").alias("place"), "line")


def truncate_lines(lines: DataFrame, by: str, most: int = 150) -> DataFrame:
    """(by, place, line): the first ``most`` lines of each text, and a note of how many more there are."""
    few = lines.where(F.col("place") <= most)
    more = lines.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most)
    note = more.select(by, F.lit(most + 1).alias("place"), F.format_string("(%d more lines)", F.col("n") - most).alias("line"))
    return few.select(by, F.col("place").cast("int").alias("place"), "line").unionByName(note)
