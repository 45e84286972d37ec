"""Text of tool payloads of any depth and size: JSON parsed by the batch, walked without recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from memspark.functions import lexicon
from memspark.session import ship_package

MOST_CHARS = 16384
_STRING = re.compile(r'("[^"\\]*(?:\\.[^"\\]*)*")(\s*:)?', re.DOTALL)


def leaves(value) -> Iterator[str]:
    """The leaves of a parsed value in order: strings, and '' for all else, an empty container too."""
    stack = [iter((value,))]
    while stack:
        for v in stack[-1]:
            if isinstance(v, (dict, list)) and v:
                stack.append(iter(v.values() if isinstance(v, dict) else v))
                break
            yield v if isinstance(v, str) else ""
        else:
            stack.pop()


def _leaves_of(payload: str) -> Iterator[str]:
    try:
        yield from leaves(json.loads(payload))
    except RecursionError:  # nested too deep for the parser: each string that isn't a name, from left to right
        yield from (json.loads(m[1], strict=False) for m in _STRING.finditer(payload) if not m[2])
    except ValueError:
        return


def joined(payload: str | None, most: int = MOST_CHARS) -> str:
    """The first ``most`` characters of a payload's leaves by lines; what isn't JSON has none."""
    out, size = [], 0
    for x in _leaves_of(payload) if payload else ():
        out.append(x)
        size += len(x) + 1
        if size > most:
            break
    return "\n".join(out)[:most]


def post_text(tool: str | None, given: str | None, response: str | None, fields: dict[str, list[str]], most: int = MOST_CHARS) -> str:
    """A finished tool's own input fields, then its response, by lines, at most ``most`` characters."""
    try:
        read = json.loads(given) if given else {}
    except (ValueError, RecursionError):
        read = {}
    parts = [read.get(k) for k in fields.get(tool or "", [])] if isinstance(read, dict) else []
    return "\n".join([p for p in parts if isinstance(p, str) and p] + [x for x in (joined(response, most),) if x])[:most]


def nested_strings(payload: Column, most: int = MOST_CHARS) -> Column:
    """All string values of a JSON payload at any depth, in order, by lines; a number or flag is an empty line. Null and what isn't JSON give ''."""
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([joined(p, most) for p in s], index=s.index, dtype="object")

    return run(payload)


def post_tool_text(tool: Column, given: Column, response: Column, fields: dict[str, list[str]] = lexicon.POST_TOOL_FIELDS, most: int = MOST_CHARS) -> Column:
    """What is known of a finished tool call: its input's text fields in their order, then all strings of its response."""
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, g, r in batches:
            yield pd.Series([post_text(*x, fields, most) for x in zip(t, g, r, strict=True)], index=t.index, dtype="object")

    return run(tool, given, response)
