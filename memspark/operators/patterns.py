"""Many patterns in one pass over texts: an automaton of their literal parts, run where the texts are.

A pattern is what stands between the ``%`` of a LIKE: ``_`` is any character, ``%`` any run, ``\\`` takes the
next character as it is; case doesn't count. The longest literal part of each pattern goes into an
Aho-Corasick automaton, which one pass over a text runs through however many patterns there are; a
pattern with wildcards is then held against the text by itself. Patterns are taken in chunks of bounded
size, an automaton and a pass for each, so nothing that grows with the data is sent to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memspark.session import materialize, ship_package

#: Patterns of one automaton, and characters of them.
CHUNK, CHUNK_CHARS = 100_000, 4_000_000
_MATCHERS: dict[int, Matcher] = {}


def parts(pattern: str) -> tuple[str, re.Pattern | None]:
    """A pattern's longest literal part, and the expression it stands for if it isn't all literal."""
    pieces, literal, expression, plain = [], "", "", True
    escaped = False
    for c in pattern:
        if not escaped and c == "\\":
            escaped = True
            continue
        if not escaped and c in "_%":
            pieces.append(literal)
            literal, plain = "", False
            expression += "." if c == "_" else ".*"
        else:
            literal += c
            expression += re.escape(c)
        escaped = False
    pieces.append(literal)
    return max(pieces, key=len), None if plain else re.compile(expression, re.DOTALL)


class Matcher:
    """Finds which of its patterns a lower-case text contains."""

    def __init__(self, patterns: list[str]) -> None:
        import ahocorasick

        self.patterns, self.rules, self.always, by_literal = patterns, [], [], {}
        for i, p in enumerate(patterns):
            literal, rule = parts(p.lower())
            self.rules.append(rule)
            if literal:
                by_literal.setdefault(literal, []).append(i)
            else:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            self.automaton.add_word(literal, numbers)
        if by_literal:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[str]:
        tried = dict.fromkeys(self.always)
        if len(self.automaton):
            for _, numbers in self.automaton.iter(text):
                tried |= dict.fromkeys(numbers)
        return [self.patterns[i] for i in tried if self.rules[i] is None or self.rules[i].search(text)]


def matches(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "content", chunk: int = CHUNK, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id_col, pattern) of every text that contains a pattern, once each, as ``lower(text) LIKE '%' || lower(pattern) || '%'`` says.

    Null texts and patterns match nothing, the empty pattern every text. Of patterns one chunk at a time
    reaches the driver; each goes out with its pass over the texts.
    """
    spark = texts.sparkSession
    ship_package(spark)
    told = materialize(patterns.select("pattern").where("pattern is not null").distinct(), "patterns")
    n, chars = told.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    chunks = max(1, -(-n // chunk), -(-chars // chunk_chars))
    kind = texts.schema[id_col].dataType.simpleString()
    own = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))

    def passed(wanted: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = hash(tuple(wanted))
            if key not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[key] = Matcher(wanted)
            for b in batches:
                hits = [_MATCHERS[key].found(t) for t in b.column(1).to_pylist()]
                at = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([p for h in hits for p in h], pa.string())], names=["id", "pattern"])

        return own.mapInArrow(run, f"id {kind}, pattern string")

    out = None
    for i in range(chunks):
        wanted = sorted(r[0] for r in told.where(F.pmod(F.xxhash64("pattern"), F.lit(chunks)) == i).collect())
        rows = passed(wanted)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumnRenamed("id", id_col)

