"""Events of a session: what a prompt or a tool call is shown, as joins keyed by the event.

A prompt runs through intents, retrieval, the relevance gates and the caps of its session, and
leaves one telemetry row. Only deliveries count against a cap, so the k-th delivery of an item in a
session is the k-th event that would show it, and caps are ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.functions import classify, lexicon
from memspark.functions.text import age_days, clip, extract_symbols, scrub
from memspark.operators import index, relevance, search
from memspark.operators.telemetry import damped
from memspark.session import materialize

THREAD_CAP, REBUILD_CAP, STALE_CAP = 2, 3, 3
RETRIEVED, RETRIEVED_CORRECTIONS, NUDGED, SHOWN = 10, 5, 5, 3


def thread_texts(threads: DataFrame, decisions: DataFrame, dead_ends: DataFrame) -> DataFrame:
    """(thread_id, item_text): a thread's name, its decisions' titles and its dead ends' approaches, lower-case.

    ``threads`` (thread_id, name), ``decisions`` (thread_id, title) and ``dead_ends`` (thread_id,
    approach) in any state; summaries have no part. One word of a thread is a row, so no text of a
    thread is gathered: gates read words.
    """
    parts = threads.select("thread_id", F.col("name").alias("t")).unionByName(decisions.select("thread_id", F.col("title").alias("t"))).unionByName(dead_ends.select("thread_id", F.col("approach").alias("t")))
    known = parts.join(threads.select("thread_id").distinct(), "thread_id", "left_semi").where("t is not null")
    return known.select("thread_id", F.explode(relevance.word_runs(F.lower("t"))).alias("item_text")).distinct()


def turns(prompts: DataFrame, builds: list[str] = lexicon.BUILD_INTENT, past: list[str] = lexicon.PAST_TENSE, investigations: list[str] = lexicon.INVESTIGATION_INTENT, decisions: list[str] = lexicon.DECISION_INTENT, openers: list[str] = lexicon.SYSTEM_TURN_OPENERS) -> DataFrame:
    """Prompts (prompt_id, session_id, pos, prompt, ...) scrubbed, with flags; a system turn has no intents."""
    rows = prompts.withColumn("prompt", scrub(F.col("prompt")))
    c = F.col("prompt")
    marker = F.try_element_at(F.filter(F.array(*(F.lit(o) for o in openers)), lambda o: F.startswith(F.regexp_replace(c, r"^\s+", ""), o)), F.lit(1))
    rows = rows.withColumn("marker", marker).withColumn("system_turn", F.col("marker").isNotNull())
    own = ~F.col("system_turn")
    return rows.withColumns({"build": own & classify.build_intent(c, builds, past), "investigate": own & classify.investigation_intent(c, investigations), "decide": own & classify.decision_intent(c, decisions)})


def _retrieved(chunks: DataFrame, vectors: DataFrame, asked: DataFrame, kept: index.Index | None) -> DataFrame:
    """(prompt_id, id, leg, rank) of vetted chunks and of corrections."""
    queries = asked.select(F.col("prompt_id").alias("query_id"), F.col("prompt").alias("query"), "vector")
    vetted = classify.vetted(F.col("do_not_rebuild"), F.col("is_correction"), F.col("is_decision"), F.col("signal_weight"))
    flags = ("signal_weight", "do_not_rebuild", "is_correction", "is_decision")
    k = max(RETRIEVED, RETRIEVED_CORRECTIONS)
    text, near = search.legs(chunks, vectors, queries, k, text=index.search(kept, queries, 3 * k)[0] if kept else None)
    subs = search.combined(chunks, text, near, RETRIEVED, vetted, flags).select("query_id", "id", F.lit(0).alias("leg"), "rank")
    corrections = search.combined(chunks, text, near, RETRIEVED_CORRECTIONS, F.coalesce(F.col("is_correction"), F.lit(False)), flags).select("query_id", "id", F.lit(1).alias("leg"), "rank")
    return subs.unionByName(corrections).withColumnRenamed("query_id", "prompt_id")


def item_line(module: Column, content: Column, path: Column, source: Column) -> Column:
    return F.concat(F.lit("  - ["), F.coalesce(F.nullif(module, F.lit("")), F.lit("-")), F.lit("] "), clip(content, 160), F.lit("  ("), F.coalesce(F.nullif(path, F.lit("")), source), F.lit(")"))


def prompt_pipeline(turned: DataFrame, chunks: DataFrame, vectors: DataFrame, threads: DataFrame, thread_words: DataFrame, idfs: DataFrame, now: Column, symbols: list[str] = lexicon.SYMBOL_PATTERNS, sources: list[str] = lexicon.NARRATIVE_SOURCES, paths: list[str] = lexicon.NARRATIVE_PATHS, kept: index.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, telemetry) of turns: what is shown, and one row for each prompt.

    ``turned``: :func:`turns` with ``vector``. ``chunks`` (id, content, source, module, aliases,
    file_path, date, ingested_at, signal_weight, do_not_rebuild, is_correction, is_decision), ``threads`` (thread_id,
    lineage: the cached text or its fallback), ``thread_words`` (thread_id, item_text), ``idfs``
    (term, idf, n_docs) of all prompts' tokens. Blocks (prompt_id, kind, item, body): kind
    ``rebuild`` has the lines of the chunks that pass the item gate, vetted ones first; ``stale``
    rides on it, with a line for each of its narrative chunks that cites symbols: age at ``now``, file
    or source, the first five symbols and how many more; ``lineage`` has one row for each of the two best threads, for prompts that build or decide. A session that saw a block ``*_CAP`` times
    sees it no more; a null session has no cap. The two best threads are chosen before the cap.
    ``matched`` in the telemetry maps ``dnr`` and each shown thread to the tokens that let it through, with
    their idf; a system turn has its marker there instead. ``kept`` is an index of the chunks' content.
    """
    asked = turned.where(F.col("build") | F.col("investigate") | F.col("decide"))
    found = materialize(_retrieved(chunks, vectors, asked, kept), "retrieved")
    # Of the chunks only those that were found are read from here on, and written once.
    mine = materialize(chunks.join(found.select("id").distinct(), "id", "left_semi").select("id", "content", "source", "module", "aliases", "file_path", "date", "ingested_at"), "found")
    gate = materialize(relevance.item_pairs(asked.select("prompt_id", "prompt"), found.select("prompt_id", "id").distinct(), _item_words(mine), idfs).where("passed"), "gate")
    wanted = found.join(gate.select("prompt_id", F.col("item_id").alias("id")), ["prompt_id", "id"])
    shown = wanted.join(mine.drop("aliases"), "id")
    narrative = classify.is_narrative(F.col("source"), F.col("file_path"), sources, paths)
    stale_line = citation(F.coalesce("date", "ingested_at"), now, F.coalesce(F.nullif("file_path", F.lit("")), F.col("source")), extract_symbols(F.col("content"), symbols))
    cited = F.when(narrative, stale_line)
    line = item_line(F.col("module"), F.col("content"), F.col("file_path"), F.col("source"))
    # 15 rows for each prompt at most.
    told = F.array_sort(F.collect_list(F.struct("leg", "rank", line.alias("line"), "module", cited.alias("cited"))))
    per = materialize(shown.groupBy("prompt_id").agg(told.alias("items")), "shown")
    per = per.withColumn("topics", F.array_distinct(F.filter(F.transform("items", lambda x: x["module"]), lambda m: m.isNotNull() & (m != ""))))
    per = per.withColumn("cited", F.filter(F.transform("items", lambda x: x["cited"]), lambda c: c.isNotNull()))
    where = turned.select("prompt_id", "session_id", "pos")
    rebuild = damped(per.join(where, "prompt_id").withColumn("item", F.lit("dnr")), ["session_id", "item"], ["pos", "prompt_id"], REBUILD_CAP)
    stale = damped(rebuild.where(F.size("cited") > 0).drop("delivery").withColumn("item", F.lit("stale")), ["session_id", "item"], ["pos", "prompt_id"], STALE_CAP)
    hits = relevance.thread_hits(relevance.lineage_gate(asked.where("build or decide").select("prompt_id", "prompt"), thread_words.withColumnRenamed("thread_id", "item_id"), idfs))
    hits = hits.withColumn("item", F.concat(F.lit("thread:"), F.col("item_id").cast("string"))).join(where, "prompt_id")
    hits = materialize(hits, "thread_hits")
    lineage = damped(hits, ["session_id", "item"], ["pos", "prompt_id"], THREAD_CAP)
    bodies = threads.select(F.col("thread_id").alias("item_id"), "lineage")
    blocks = (
        rebuild.select("prompt_id", F.lit("rebuild").alias("kind"), "item", F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("body"))
        .unionByName(stale.select("prompt_id", F.lit("stale").alias("kind"), "item", F.array_join("cited", "\n").alias("body")))
        .unionByName(lineage.join(bodies, "item_id").select("prompt_id", F.lit("lineage").alias("kind"), "item", F.col("lineage").alias("body")))
    )
    counts = found.groupBy("prompt_id").agg(F.count("*").alias("retrieved"))
    gave = blocks.groupBy("prompt_id").agg(F.bool_or(F.col("kind") == "rebuild").alias("rebuild"), F.bool_or(F.col("kind") == "stale").alias("stale"), F.sort_array(F.collect_list(F.when(F.col("kind") == "lineage", F.col("item")))).alias("threads"))
    wished = per.select("prompt_id", F.lit("dnr").alias("item")).unionByName(rebuild.where(F.size("cited") > 0).select("prompt_id", F.lit("stale").alias("item"))).unionByName(hits.select("prompt_id", "item"))
    held = wished.join(blocks.select("prompt_id", "item"), ["prompt_id", "item"], "left_anti").groupBy("prompt_id").agg(F.sort_array(F.collect_list("item")).alias("suppressed"))
    pairs = F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", F.round("idf", 3).alias("idf")))))
    through = gate.select("prompt_id", F.lit("dnr").alias("item"), F.explode("matched").alias("term", "idf")).unionByName(lineage.select("prompt_id", "item", F.explode("matched").alias("term", "idf")))
    matched = through.groupBy("prompt_id", "item").agg(pairs.alias("tokens")).groupBy("prompt_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", F.to_json("tokens").alias("tokens"))))).alias("matched"))
    none = F.array().cast("array<string>")
    rows = turned.join(matched, "prompt_id", "left")
    rows = rows.join(counts, "prompt_id", "left").join(per.select("prompt_id", "topics"), "prompt_id", "left").join(gave, "prompt_id", "left").join(held, "prompt_id", "left")
    telemetry = rows.select(
        "prompt_id", "session_id", F.sha2("prompt", 256).alias("prompt_hash"), F.substring("prompt", 1, 200).alias("prompt_truncated"), "system_turn", "build", "investigate", "decide",
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.coalesce("topics", none).alias("topics"), F.coalesce("rebuild", F.lit(False)).alias("rebuild_shown"), F.coalesce("stale", F.lit(False)).alias("stale_shown"), F.coalesce("threads", none).alias("threads"), F.coalesce("suppressed", none).alias("suppressed"),
        F.when(F.col("system_turn"), F.create_map(F.lit("system_turn"), F.col("marker"))).otherwise(F.coalesce("matched", F.create_map().cast("map<string,string>"))).alias("matched"),
    )
    return blocks, telemetry


def citation(written: Column, now: Column, where: Column, symbols: Column) -> Column:
    """One narrative chunk's line: its age in days (? if it can't be read), file or source, five symbols and how many more; null without symbols."""
    age = F.coalesce(age_days(written.cast("string"), now).cast("string"), F.lit("?"))
    more = F.when(F.size(symbols) > 5, F.format_string(" (+%d more)", F.size(symbols) - 5)).otherwise("")
    return F.when(F.size(symbols) > 0, F.concat(F.lit("  - ["), age, F.lit("d old] "), where, F.lit(": symbols "), F.array_join(F.slice(symbols, 1, 5), ", "), more))


def _item_words(found: DataFrame) -> DataFrame:
    """(item_id, item_text) of chunks."""
    text = relevance.item_text(F.nullif("content", F.lit("")), F.nullif("module", F.lit("")), F.nullif("aliases", F.lit("")), F.nullif("file_path", F.lit("")))
    return found.select(F.col("id").alias("item_id"), text.alias("item_text"))


def nudge_hits(calls: DataFrame, chunks: DataFrame, vectors: DataFrame, names: list[str], tools: list[str] = lexicon.NUDGE_TOOLS, intent: Column | None = None, kept: index.Index | None = None) -> DataFrame:
    """(call_id, id, final_score, rank) of tool calls (call_id, tool, text, vector) whose text shows an intent.

    Calls of other tools, empty texts and texts that speak of this system itself (``names``) ask
    nothing. Of the vetted hits those above the floor stay.
    """
    c = F.col("text")
    fires = classify.is_nudge_tool(F.col("tool"), tools) & (F.coalesce(c, F.lit("")) != "") & ~classify.is_self_referential(c, names) & (classify.any_intent(c) if intent is None else intent)
    queries = calls.where(fires).select(F.col("call_id").alias("query_id"), c.alias("query"), "vector")
    vetted = classify.vetted(F.col("do_not_rebuild"), F.col("is_correction"), F.col("is_decision"), F.col("signal_weight"))
    text = index.search(kept, queries, 3 * NUDGED)[0] if kept else None
    rows = search.hybrid(chunks, vectors, queries, NUDGED, vetted, ("signal_weight", "do_not_rebuild", "is_correction", "is_decision"), text=text)
    return rows.where(classify.above_floor(F.col("final_score"), F.col("fusion_score"))).select(F.col("query_id").alias("call_id"), "id", "final_score", "rank")


def pre_nudges(hits: DataFrame, most: int = SHOWN) -> DataFrame:
    """The ``most`` best hits of each call, shown before the tool runs."""
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("rank"))
    return hits.withColumn("place", place).where(F.col("place") <= most).drop("rank")


def post_nudges(hits: DataFrame, calls: DataFrame, delivered: DataFrame) -> DataFrame:
    """(session_id, call_id, id): after each call its best hit that the session hasn't been shown yet.

    ``calls`` (call_id, session_id, pos), ``delivered`` (session_id, id) from before. Calls of a
    session come in order, and a delivery of one is not novel for the next; five hits each make the
    state small: it is folded over a session's calls.
    """
    rows = hits.join(calls.select("call_id", "session_id", "pos"), "call_id").where("session_id is not null")
    rows = rows.join(delivered.select("session_id", "id").distinct(), ["session_id", "id"], "left_anti")
    per = rows.groupBy("session_id", "pos", "call_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("near"))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"session_id {kinds['session_id']}, call_id {kinds['call_id']}, id {kinds['id']}"
    ordered = per.repartition("session_id").sortWithinPartitions("session_id", "pos", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        was, seen = None, set()
        for part in batches:
            out = []
            for session, call, near in zip(part["session_id"], part["call_id"], part["near"], strict=True):
                if session != was:
                    was, seen = session, set()
                new = next((x["id"] for x in near if x["id"] not in seen), None)
                if new is not None:
                    seen.add(new)
                    out.append((session, call, new))
            yield pd.DataFrame(out, columns=["session_id", "call_id", "id"])

    return ordered.select("session_id", "call_id", "near").mapInPandas(run, schema)
