"""Rules on small rows: payloads of any depth and size, places, novelty, health lines and changes."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.functions import payload
from memspark.operators import capture, health, ranks


def reference_text(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, (dict, list)):
        return "\n".join(reference_text(v) for v in (value.values() if isinstance(value, dict) else value))
    return ""


NESTED = [
    {"stdout": "}, done", "k": "v"}, {"a": [",", "]", "}", ":"], "b": {"c": {"d": '", "x": "'}}}, [], {}, {"a": [], "b": 1, "c": None, "d": "x"}, "plain", 5, None, [[["deep"]], {"k:": "v:"}],
    {"esc": 'quote " slash \\ line\n tab\t é 😀'},
]


def test_nested_strings_at_any_depth(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(NESTED)] + [(90, None), (91, ""), (92, "not json {"), (93, json.dumps({"a": "x" * 2_000, "b": "y" * 10_000_000}))], "id int, p string")
    got = {r.id: r.t for r in rows.select("id", payload.nested_strings(F.col("p")).alias("t")).collect()}
    assert [got[i] for i in range(len(NESTED))] == [reference_text(v)[:16384] for v in NESTED]
    assert got[90] == got[91] == got[92] == ""
    assert got[93] == ("x" * 2_000 + "\n" + "y" * 20_000)[:16384]


def test_nesting_beyond_the_parser():
    deep = '{"k":' * 5_000 + '["in", "side"]' + "}" * 5_000
    assert payload.joined(deep) == "in\nside"
    assert payload.joined("[" * 100_000 + '"x"' + "]" * 100_000) == "x"


@pytest.mark.parametrize(
    ("tool", "given", "response", "want"),
    [
        ("Grep", {"pattern": "p", "path": "q", "command": "no"}, {"out": "r"}, "p\nq\nr"), ("Edit", {"file_path": "f", "old_string": "", "new_string": 5}, "said", "f\nsaid"), ("Read", {"file_path": "f"}, ["a", 1], "a\n"),
        (None, None, None, ""), ("Bash", "not an object", {"x": []}, ""), ("Write", {"content": "c" * 20_000}, "r", "c" * 16384),
    ],
)
def test_text_of_a_finished_tool(spark, tool, given, response, want):
    row = spark.createDataFrame([(tool, json.dumps(given) if given is not None else None, json.dumps(response) if response is not None else None)], "t string, g string, r string")
    assert row.select(payload.post_tool_text(F.col("t"), F.col("g"), F.col("r"))).first()[0] == want


def test_places_in_groups_of_any_size(spark):
    rows = [("hot", i * 7919 % 5_000, i) for i in range(5_000)] + [(None, i, i) for i in range(50)] + [(f"k{i}", 1, i) for i in range(40)]
    got = ranks.placed(spark.createDataFrame(rows, "k string, o int, i int").repartition(7), ["k"], ["o", "i"]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for p, (o, i) in enumerate(sorted((o, i) for key, o, i in rows if key == k), 1):
            want[k, o, i] = p
    assert {(r.k, r.o, r.i): r.place for r in got} == want
    assert ranks.placed(spark.createDataFrame([], "k string, o int"), ["k"], ["o"]).collect() == []


NOVEL = "id bigint, session_id string, hash string, corpus_sig string"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([], (False, "no render recorded")), ([(1, "a", None, "s")], (False, "no render recorded")), ([(1, "b", "h", "1"), (2, "a", "", "1")], (False, "no render recorded")), ([(1, "a", "h", "s")], (True, "first observation")),
        ([(1, "a", "h", ""), (2, "b", "h", "2"), (3, "c", "h", "3")], (True, "corpus idle")), ([(1, "a", "h", "1"), (2, "b", "h", "2"), (3, "c", "h", "3")], (False, "render frozen")), ([(1, "a", "h", "1"), (2, "b", "h", "2"), (3, "c", "h", None)], (False, "render frozen")),
        ([(1, "a", "h", "1"), (2, "b", "g", "1"), (3, "c", "h", "3")], (True, "render follows corpus")), ([(1, "a", "h", "1"), (2, "c", "h", "3")], (True, "too few sessions")), ([(i, "", "h", "1") for i in range(4)], (False, "guard disarmed")), ([(1, "a", "h", "1"), (2, None, "h", "1")], (True, "session unknown")),
    ],
)
def test_novelty(spark, rows, want):
    r = health.novelty(spark.createDataFrame(rows, NOVEL)).collect()
    assert [(x.ok, x.detail) for x in r] == [want]


def test_health_line_of_every_hook(spark):
    beats = spark.createDataFrame([(1, "a", "2024-01-09T00:00:00", True, "x"), (2, "a", "2024-01-10T00:00:00", True, "y"), (3, "b", "2024-01-10T00:00:00", False, "z"), (4, "c", "2024-01-01T00:00:00", True, "w"), (5, "d", "yesterday", True, "v")], "id int, hook string, ts string, ok boolean, detail string")
    hooks = spark.createDataFrame([(h,) for h in "abcde"], "hook string")
    got = {r.hook: (r.state, r.detail) for r in health.health_line(beats, F.lit(datetime(2024, 1, 10)), hooks).collect()}
    assert got == {"a": ("ok", "y"), "b": ("errored", "z"), "c": ("stale", "w"), "d": ("ok", "v"), "e": ("none", None)}
    assert [r.state for r in health.health_line(beats.limit(0), F.lit(datetime(2024, 1, 10)), hooks.limit(1)).collect()] == ["none"]


def test_changes_bump_the_owner_of_their_time(spark):
    rows = spark.createDataFrame([("x", "A", "t", "pending"), ("y", None, "t", "pending")], "id string, thread_id string, title string, state string")
    changes = [(1, "x", "supersede", "new", None, 10), (2, "x", "attach", None, "B", 20), (3, "x", "supersede", "newer", None, 30), (4, "y", "supersede", "z", None, 40), (5, "y", "attach", "named", "nowhere", 50), (6, "y", "confirm", "false", None, 60), (7, None, "summarize", "told", "C", 70), (8, "q", "confirm", None, None, 80)]
    threads = spark.createDataFrame([(t, 1, "old") for t in "ABCD"], "thread_id string, last_updated int, summary string")
    out, after = capture.outcomes_now(rows, spark.createDataFrame(changes, "seq int, id string, op string, value string, thread_id string, ts int"), threads)
    assert {tuple(r) for r in out.collect()} == {("x", "B", "t", "pending", "newer", None), ("y", None, "t", "confirmed", "z", False)}
    assert {(r.thread_id, r.last_updated, r.summary) for r in after.collect()} == {("A", 10, "old"), ("B", 30, "old"), ("C", 70, "told"), ("D", 1, "old")}


def test_backfill_keeps_the_heaviest_of_equal_decisions(spark):
    c = spark.createDataFrame([(1, "Same words here. First.", 10, 1), (2, "Same words here. First.", 90, 1), (3, "Same words here. First.", 90, 2)], "id int, content string, signal_weight int, ingested_at int")
    c = c.withColumns({"source": F.lit("doc"), "is_decision": F.lit(True), "date": F.lit("2024-01-01")})
    assert capture.backfill_decisions(c, 10)[0].count() == 1
