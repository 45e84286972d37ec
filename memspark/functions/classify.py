"""Row classifiers: rules over phrases, markers, roles and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memspark.functions import lexicon
from memspark.functions.text import phrase_any


def harness_reason(c: Column, markers: list[tuple[str, str, str]] = lexicon.HARNESS_MARKERS) -> Column:
    """The reason of the first marker that a text opens with ("prefix") or has anywhere ("tag")."""
    head = F.regexp_replace(c, r"^\s+", "")
    out = None
    for marker, reason, kind in markers:
        hit = head.startswith(marker) if kind == "prefix" else F.contains(c, F.lit(marker))
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def is_correction(c: Column, role: Column, phrases: list[str] = lexicon.CORRECTION_PHRASES) -> Column:
    """Only a person's own message corrects."""
    return F.coalesce((role == "user") & phrase_any(c, phrases), F.lit(False))


def is_decision(c: Column, phrases: list[str] = lexicon.DECISION_PHRASES) -> Column:
    return F.coalesce(phrase_any(c, phrases), F.lit(False))


def is_do_not_rebuild(c: Column, phrases: list[str] = lexicon.DO_NOT_REBUILD_PHRASES) -> Column:
    return F.coalesce(phrase_any(c, phrases), F.lit(False))


def signal_weight(c: Column, role: Column, corrections: list[str] = lexicon.CORRECTION_PHRASES, decisions: list[str] = lexicon.DECISION_PHRASES, investigations: list[str] = lexicon.INVESTIGATION_PHRASES, summaries: list[str] = lexicon.COMPACTION_MARKERS) -> Column:
    """0 to 100 from role and phrases; machine-made summaries weigh nothing."""
    user = F.when(phrase_any(c, corrections), 100).when(phrase_any(c, decisions), 50).when(phrase_any(c, investigations), 30).otherwise(10)
    assistant = F.when(phrase_any(c, decisions), 20).otherwise(0)
    return F.when(phrase_any(c, summaries), 0).when(role == "user", user).when(role == "assistant", assistant).otherwise(20)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def doc_signal_weight(path: Column, canonical: list[str] = lexicon.CANONICAL_DOCS) -> Column:
    return F.when(basename(path).isin(canonical), 50).otherwise(20)


def is_curated_correction(path: Column, prefixes: list[str] = lexicon.CURATED_PREFIXES) -> Column:
    return F.lower(basename(path)).rlike("^(" + "|".join(prefixes) + ")")


def build_intent(c: Column, verbs: list[str] = lexicon.BUILD_INTENT, past: list[str] = lexicon.PAST_TENSE) -> Column:
    return phrase_any(c, verbs) & ~phrase_any(c, past)


def investigation_intent(c: Column, phrases: list[str] = lexicon.INVESTIGATION_INTENT) -> Column:
    return phrase_any(c, phrases)


def decision_intent(c: Column, phrases: list[str] = lexicon.DECISION_INTENT) -> Column:
    return phrase_any(c, phrases)


def any_intent(c: Column) -> Column:
    return build_intent(c) | investigation_intent(c) | decision_intent(c)


def vetted(dnr: Column, correction: Column, decision: Column, weight: Column) -> Column:
    """Marked by an operator in any way, or of weight 50."""
    return F.coalesce(dnr, F.lit(False)) | F.coalesce(correction, F.lit(False)) | F.coalesce(decision, F.lit(False)) | F.coalesce(weight >= 50, F.lit(False))


def is_status_echo(title: Column, patterns: list[str] = lexicon.STATUS_ECHO) -> Column:
    return title.rlike(r"(?i)^\s*(?:" + "|".join(patterns) + r")\s*[.!]*\s*$")


def is_maintenance(c: Column, prefixes: list[str] = lexicon.MAINTENANCE_PREFIXES) -> Column:
    head, out = F.regexp_replace(c, r"^\s+", ""), F.lit(False)
    for p in prefixes:
        out = out | head.startswith(p)
    return out


def gate_reason(title: Column, shortest: int = 40, patterns: list[str] = lexicon.STATUS_ECHO) -> Column:
    """Why a candidate's title is dropped (null: it stays)."""
    return F.when(is_status_echo(title, patterns), "status_echo").when(F.length(title) < shortest, "too_short")


def is_narrative(source: Column, path: Column, sources: list[str] = lexicon.NARRATIVE_SOURCES, fragments: list[str] = lexicon.NARRATIVE_PATHS) -> Column:
    out = F.coalesce(source.isin(sources), F.lit(False))
    for f in fragments:
        out = out | F.coalesce(F.contains(path, F.lit(f)), F.lit(False))
    return out


def is_self_referential(c: Column, names: list[str]) -> Column:
    return phrase_any(c, [n.lower() for n in names])


def is_system_turn(c: Column, openers: list[str] = lexicon.SYSTEM_TURN_OPENERS) -> Column:
    head, out = F.regexp_replace(c, r"^\s+", ""), F.lit(False)
    for o in openers:
        out = out | head.startswith(o)
    return out


def is_nudge_tool(tool: Column, tools: list[str] = lexicon.NUDGE_TOOLS) -> Column:
    return tool.isin(tools)


def above_floor(final_score: Column, fusion_score: Column, floor: float = 0.01) -> Column:
    return F.coalesce(final_score, fusion_score, F.lit(0.0)) >= floor


def path_is_skipped(path: Column, skipped: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(s) for s in skipped)))


def present_tokens(c: Column, tokens: list[str]) -> Column:
    return F.filter(F.array(*(F.lit(t) for t in tokens)), lambda t: F.contains(c, t))
