"""Text functions: Column in, Column out, all of them Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions import lexicon

#: What counts as white space: Unicode separators and the control characters that split words.
WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS, " "))


def clip(c: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters; a cut word goes, and an ellipsis comes."""
    if limit <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    t = collapse_ws(c)
    head = F.substring(t, 1, limit - 1)
    blank = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
    split_word = (F.substring(t, limit, 1) != " ") & (F.instr(head, " ") > 0) & (blank > 0)
    cut = F.when(split_word, F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def sentences(c: Column) -> Column:
    """Collapsed text split after . ! or ? and a blank."""
    return F.split(collapse_ws(c), r"(?<=[.!?])\s+")


def first_sentence(c: Column) -> Column:
    return F.element_at(F.split(collapse_ws(c), r"(?<=[.!?])\s+", 2), 1)


def phrase_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text contains any of the phrases: one pass of one pattern."""
    return F.lower(c).rlike("|".join(_quoted(p) for p in phrases)) if phrases else F.lit(False)


def _quoted(p: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", p)


def sentences_with_cue(c: Column, cues: list[str]) -> Column:
    return F.filter(sentences(c), lambda s: phrase_any(s, cues))


def derive_aliases(c: Column, acronyms: list[tuple[str, list[str], list[str]]] = lexicon.ACRONYMS) -> Column:
    """The other forms of the acronyms and expansions that a text has, sorted, joined by `` | ``."""
    low, parts = F.lower(c), []
    for short, forms, surface in acronyms:
        has_short = F.lit(False)
        for s in surface or [short]:
            has_short = has_short | (c if surface else low).rlike(f"(?<![A-Za-z0-9]){_quoted(s)}(?![A-Za-z0-9])")
        parts.append(F.when(has_short, strings(forms)).otherwise(strings([])))
        has_form = F.lit(False)
        for f in forms:
            has_form = has_form | low.rlike(f"(?<![a-z0-9]){_quoted(f)}(?![a-z0-9])")
        parts.append(F.when(has_form, strings([short])).otherwise(strings([])))
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*parts)))), " | ") if parts else F.lit("")


def detect_module(c: Column, roster: list[str]) -> Column:
    """The roster name that stands first in the text as a whole token (``_`` ends tokens); ties keep roster order."""
    low = F.lower(c)
    found = []
    for i, name in enumerate(roster):
        at = F.regexp_instr(low, F.lit(f"(?<![a-z0-9]){_quoted(name.lower())}(?![a-z0-9])"))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name"))))
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))["name"] if found else F.lit(None).cast("string")


def significant_tokens(c: Column, stopwords: list[str] = lexicon.STOPWORDS, short: list[str] = lexicon.ALLOWED_SHORT) -> Column:
    """Distinct lower-case alphanumeric tokens in order, without stopwords; of 4 characters, or listed."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: ~t.isin(stopwords) & ((F.length(t) >= 4) | t.isin(short)) & (t != "")))


def meta_tokens(phrases: list[str] = lexicon.DECISION_INTENT, stopwords: list[str] = lexicon.STOPWORDS, short: list[str] = lexicon.ALLOWED_SHORT) -> list[str]:
    """Significant words of intent phrases: they say that someone decides, not on what."""
    words = {w for p in phrases for w in re.findall("[a-z0-9]+", p.lower())}
    return sorted(w for w in words if w not in stopwords and (len(w) >= 4 or w in short))


def prompt_tokens(c: Column) -> Column:
    """Significant tokens of a prompt less the vocabulary of deciding."""
    return F.array_except(significant_tokens(c), strings(meta_tokens()))


def word_match(token: Column, haystack: Column) -> Column:
    """Whether a lower-case token stands as a whole word (``_`` belongs to words) in a lower-case text."""
    return F.regexp_like(haystack, F.concat(F.lit(r"\b\Q"), token, F.lit(r"\E\b")))


def extract_topic(c: Column, patterns: list[str] = lexicon.TOPIC_PATTERNS, stopwords: list[str] = lexicon.TOPIC_STOPWORDS) -> Column:
    """The first symbol by the most specific pattern that matches, else the first longer word, else ''.

    Patterns stand between word boundaries, so each is held against whole words.
    """
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"))

    def first(pattern: str) -> Column:
        return F.try_element_at(F.filter(words, lambda w: w.rlike(f"^{pattern}$")), F.lit(1))

    symbols = [first(p.removeprefix(r"\b").removesuffix(r"\b")) for p in patterns]
    plain = F.filter(words, lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(stopwords))
    return F.coalesce(*symbols, F.try_element_at(plain, F.lit(1)), F.lit(""))


def extract_symbols(c: Column, patterns: list[str] = lexicon.SYMBOL_PATTERNS) -> Column:
    """Distinct cited symbols, by pattern, then by place."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(p)) for p in patterns)))


def scrub(c: Column) -> Column:
    """Control characters other than tab and line ends become blanks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def content_id(c: Column) -> Column:
    """SHA-256 of the collapsed text."""
    return F.sha2(collapse_ws(c), 256)


def short_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def slug(c: Column) -> Column:
    """Lower case, runs of other than letters and digits become ``-``, at most 64 characters."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), 1, 64)


def tool_text(tool: Column, payload: Column, fields: dict[str, list[str]] = lexicon.TOOL_FIELDS, most: int = 16384) -> Column:
    """The actionable text of a tool's JSON payload: its non-empty fields by lines, at most 16384 characters."""
    out = F.lit("")
    for name, keys in fields.items():
        parts = [F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in keys]
        out = F.when(tool == name, F.concat_ws("\n", *parts)).otherwise(out)
    return F.substring(out, 1, most)


def age_days(ts: Column, now: Column) -> Column:
    """Whole days since an ISO timestamp; null if it can't be read."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(ts))) / 86400)


def format_age(seconds: Column) -> Column:
    """3.2d, 5.1h or 4m."""
    return F.when(seconds >= 86400, F.format_string("%.1fd", seconds / 86400.0)).when(seconds >= 3600, F.format_string("%.1fh", seconds / 3600.0)).otherwise(F.format_string("%dm", F.floor(seconds / 60)))


def module_of_path(path: Column, roster: list[str], roots: list[str], state_suffix: str = ".state.yaml") -> Column:
    """The roster name in a path's segments or stem, for paths below the given roots; state files give their stem."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    under = F.lit(False)
    for r in roots:
        under = under | F.contains(low, F.lit(r.lower()))
    parts = F.concat(F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1), F.array(stem))
    hit = F.filter(parts, lambda p: p.isin([m.lower() for m in roster]))
    state = F.when(name.endswith(state_suffix), F.regexp_replace(name, _quoted(state_suffix) + "$", ""))
    return F.when(under, F.coalesce(state, F.try_element_at(hit, F.lit(1))))


def sections(docs: DataFrame, id_col: str, text_col: str, heading: str = r"[^\S\n]*#{2,3} ") -> DataFrame:
    """(id_col, section, raw, first): texts cut before lines that begin with a heading, and the number of each piece's first line.

    A text is cut by itself: nothing is shuffled. ``heading`` must not match a line end. Sections
    count headings, so what stands before the first one is section 0; lines count from 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.split(text, rf"\n(?={heading})")
    lines = F.transform("_p", lambda x: _breaks(x) + 1)
    firsts = F.aggregate(lines, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = docs.select(id_col, pieces.alias("_p"), text.rlike(rf"\A{heading}").cast("int").alias("_h"))
    rows = rows.select(id_col, "_h", F.posexplode(F.arrays_zip(F.col("_p").alias("raw"), F.slice(firsts, F.lit(1), F.size("_p")).alias("first"))).alias("_i", "_x"))
    return rows.select(id_col, (F.col("_i") + F.col("_h")).alias("section"), "_x.raw", "_x.first")


def _breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def split_sections(docs: DataFrame, id_col: str, text_col: str, heading: str = r"[^\S\n]*#{2,3} ", window: int = 6000) -> DataFrame:
    """(id_col, section, part, text, line_start, line_end): pieces that begin at headings, cut into windows.

    Lines are 1-based; a part's bounds are the lines its characters stand on. Blank pieces go.
    """
    whole = sections(docs, id_col, text_col, heading)
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    whole = whole.withColumn("lead", lead).withColumn("body", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("body <> ''")
    parts = whole.select("*", F.explode(F.sequence(F.lit(0), F.length("body") - 1, F.lit(window))).alias("from"))
    text = F.substring(F.col("body"), F.col("from") + 1, F.lit(window))
    start = F.col("first") + 1 + _breaks(F.substring(F.col("raw"), F.lit(1), F.col("lead") + F.col("from")))
    return parts.select(id_col, "section", (F.col("from") / window).cast("int").alias("part"), text.alias("text"), start.cast("int").alias("line_start"), (start + _breaks(text)).cast("int").alias("line_end"))
