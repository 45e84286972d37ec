"""The incremental flow on real files: order, deadline, watermark, failures, replacement, equality with one file after the other."""

from __future__ import annotations

import json
import os
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memspark.functions import classify
from memspark.operators import ingest


@pytest.fixture
def tree(tmp_path):
    def put(name: str, text: str, at: int) -> Path:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        os.utime(p, (at, at))
        return p

    return tmp_path, put


def sources(root: Path) -> list:
    memory = ingest.Files("memory", f"file://{root}/memory", lambda p: F.lit(40), classify.is_curated_correction, front_matter=True)
    ledger = ingest.Files("ledger", f"file://{root}/ledgers", lambda p: F.lit(30))
    return [memory, ledger, ingest.Logs("sessions", f"file://{root}/logs"), ingest.Files("doc", f"file://{root}/docs")]


def now(spark, state: str) -> set:
    return {(Path(r["file_path"]).name if r["file_path"] else r["session_id"], r["content"]) for r in ingest.stored(spark, state).collect()}


def message(text: str) -> str:
    return json.dumps({"timestamp": "2024-01-05T00:00:00", "message": {"role": "user", "content": [{"type": "text", "text": text}]}}) + "\n"


def test_runs(spark, tree):
    root, put = tree
    state = f"file://{root}/state"
    put("memory/feedback_a.md", "---\ntype: feedback\n---\n## One\nalways use the queue\n", 1000)
    put("docs/x.md", "before\n## A\nfirst\n## B\nsecond\n", 2000)
    put("docs/y.md", "## A\nfirst\n", 2000)  # holds a section that x.md has
    put("docs/.git/z.md", "## no\nnever\n", 2000)
    put("logs/s1.jsonl", message("said before the first run"), 1000)

    none = {r["source"]: r for r in ingest.run(spark, state, sources(root), [], budget_s=0).collect()}
    assert all(not r["files_ingested"] and r["chunks_added"] == 0 for r in none.values()) and not now(spark, state)

    first = {r["source"]: r for r in ingest.run(spark, state, sources(root), ["queue"]).collect()}
    assert (first["memory"]["files_ingested"], first["doc"]["files_ingested"], first["doc"]["chunks_added"]) == (1, 2, 3)
    assert first["ledger"]["files_ingested"] == 0 and first["sessions"]["chunks_added"] == 0
    assert now(spark, state) == {("feedback_a.md", "## One\nalways use the queue"), ("x.md", "before"), ("x.md", "## A\nfirst"), ("x.md", "## B\nsecond")}
    row = ingest.stored(spark, state).where("source = 'memory'").first()
    assert (row["signal_weight"], row["is_correction"], row["module"]) == (40, True, "queue")

    with open(root / "logs/s1.jsonl", "a") as f:
        f.write(message("said after it") + "{broken\n" + message("said after it"))
    put("docs/x.md", "## B\nsecond\n", 3000)  # rewritten
    put("docs/v.md", "## V\nas new as the newest read\n", 2000)
    put("docs/old.md", "## O\nolder than the watermark\n", 1500)
    second = {r["source"]: r for r in ingest.run(spark, state, sources(root), []).collect()}
    assert (second["doc"]["files_ingested"], second["doc"]["files_skipped"], second["sessions"]["chunks_added"], second["memory"]["files_ingested"]) == (2, 2, 1, 0)
    assert now(spark, state) == {("feedback_a.md", "## One\nalways use the queue"), ("x.md", "## B\nsecond"), ("v.md", "## V\nas new as the newest read"), ("s1", "said after it")}

    third = ingest.run(spark, state, sources(root), []).agg(F.sum("files_ingested"), F.sum("chunks_added")).first()
    assert tuple(third) == (0, 0)
    assert ingest.log(spark, state).where("action = 'ingest'").count() == 5


def test_failures_hold_the_watermark(spark, tree):
    root, put = tree
    state = f"file://{root}/state"
    put("docs/a.md", "## A\na\n", 1000)
    gone = root / "docs/b.md"
    gone.symlink_to(root / "held.md")
    put("held.md", "## B\nb\n", 1500)
    put("docs/c.md", "## C\nc\n", 2000)
    only = [ingest.Files("doc", f"file://{root}/docs")]
    files = ingest.listed(spark, only[0], [])
    assert files.count() == 3
    real = ingest.listed
    try:  # b.md goes between listing and reading
        kept = spark.createDataFrame(files.collect(), files.schema)
        ingest.listed = lambda *_: kept
        shutil.move(root / "held.md", root / "away.md")
        got = ingest.run(spark, state, only, []).first()
        assert (got["files_ingested"], got["files_failed"], got["files_skipped"]) == (2, 1, 1)
        assert [r["action"] for r in ingest.log(spark, state).orderBy("file_path").collect()] == ["ingest", "read_fail", "ingest"]
        shutil.move(root / "away.md", root / "held.md")
        got = ingest.run(spark, state, only, []).first()
        assert (got["files_ingested"], got["files_skipped"], got["files_failed"]) == (1, 2, 0)  # c.md isn't read again
    finally:
        ingest.listed = real
    assert now(spark, state) == {("a.md", "## A\na"), ("b.md", "## B\nb"), ("c.md", "## C\nc")}
    assert ingest.run(spark, state, only, []).first()["files_ingested"] == 0


def test_cut_runs_go_on(spark, tree):
    root, put = tree
    state = f"file://{root}/state"
    for i in range(7):
        put(f"docs/{i}.md", f"## {i}\ntext\n", 9000 - i)  # paths against times
    only, ticks = [ingest.Files("doc", f"file://{root}/docs")], iter(range(100))
    cut = ingest.run(spark, state, only, [], budget_s=3.5, wave_files=2, clock=lambda: next(ticks)).first()
    assert (cut["files_ingested"], cut["files_left"]) == (4, 3)
    assert {n for n, _ in now(spark, state)} == {"6.md", "5.md", "4.md", "3.md"}  # the oldest first
    rest = ingest.run(spark, state, only, [], wave_files=2).first()
    assert (rest["files_ingested"], rest["files_left"], rest["files_skipped"]) == (3, 0, 4)
    # a wave that died before its manifest counts for nothing
    shutil.rmtree(root / "state/manifest/w00000004")
    assert len(now(spark, state)) == 6
    again = ingest.run(spark, state, only, []).first()
    assert again["files_ingested"] == 1 and len(now(spark, state)) == 7


def test_equals_one_file_after_the_other(spark, tree):
    """Random rewrites of files with shared sections, against a dictionary that takes files in turn."""
    root, put = tree
    state, rnd, clock = f"file://{root}/state", random.Random(3), 1000
    owner: dict[str, str] = {}
    for _ in range(3):
        touched = rnd.sample(range(8), 5)
        for n in touched:
            clock += 1
            parts = rnd.sample(range(10), rnd.randint(1, 4))
            put(f"docs/{n}.md", "".join(f"## s{k}\nbody {k}\n" for k in parts), clock)
            owner = {c: f for c, f in owner.items() if f != f"{n}.md"}
            for k in parts:
                owner.setdefault(f"## s{k}\nbody {k}", f"{n}.md")
        ingest.run(spark, state, [ingest.Files("doc", f"file://{root}/docs")], [])
        assert now(spark, state) == {(f, c) for c, f in owner.items()}
