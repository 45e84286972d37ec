"""Backfills with every kind of record and their dry run; report files; versions that are never overwritten; hashes of blocks."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from memspark.operators import capture, health, ingest, telemetry


def put(root: Path, name: str, text: str) -> None:
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_backfill_and_dry_run(spark, tmp_path):
    def said(role: str, text: str) -> str:
        return json.dumps({"timestamp": "2024-01-05", "message": {"role": role, "content": text}}) + "\n"

    put(tmp_path, "sessions/s1.jsonl", said("user", "a question") + said("assistant", "no weight") + said("user", "<system-reminder>echo</system-reminder>") + said("user", "shared  words"))
    put(tmp_path, "docs/a.md", "## A\nfirst\n")
    put(tmp_path, "docs/b.md", "shared words\n## A\nfirst\n")
    put(tmp_path, "memory/feedback_x.md", "---\ntype: feedback\n---\nkeep the gate\n")
    put(tmp_path, "memory/note.md", "---\ntype: note\n---\n## A\nfirst\n## M\nonly here\n")
    put(tmp_path, "exp/run7/progress.jsonl", '{"tick": 1}\n{"tick": 9, "coverage_classes": ["a", "b"]}\n{bad\n')
    put(tmp_path, "git/log.txt", "f" * 40 + "\tsomeone\t2024-01-05\tsubject\nbody\n\x1e")
    p = {k: str(tmp_path / k) for k in ("sessions", "docs", "memory", "git")}
    chunks, counts = ingest.backfill(spark, ingest.Project(experiments=str(tmp_path / "exp/run7"), **p), ["gate"], ["gate"])
    got = {r["content"]: r for r in chunks.collect()}
    assert set(got) == {"a question", "shared  words", "## A\nfirst", "keep the gate", "## M\nonly here", "Experiment run7: final_tick=9 n_completed_tasks=? coverage_total=? coverage_classes=2 ddx_intents_total=?", "subject\n\nbody"}
    assert got["shared  words"]["source"] == "claude_code" and got["## A\nfirst"]["file_path"].endswith("a.md")
    memory = got["keep the gate"]
    assert (memory["source"], memory["module"], memory["do_not_rebuild"], memory["is_correction"], memory["signal_weight"]) == ("memory", "gate", True, True, 40)
    assert got["subject\n\nbody"]["file_path"] == "git:" + "f" * 12
    assert {(r["source"], r["n_read"], r["n_harness"], r["n_weightless"]) for r in counts.collect()} == {("claude_code", 4, 1, 1), ("doc", 3, 0, 0), ("memory", 3, 0, 0), ("experiment_summary", 1, 0, 0), ("git", 1, 0, 0)}
    rows = ingest.dry_run(chunks, 3, str(tmp_path / "sample")).collect()
    assert [r["source"] for r in rows] == ["claude_code", "claude_code", "doc"] and all(len(r["head"]) <= 120 for r in rows)
    with pytest.raises(ValueError):
        ingest.backfill(spark, ingest.Project(), [])


def test_weekly_file(spark, tmp_path):
    now = datetime(2024, 1, 31, 12)
    call = "id long, ts timestamp, latency_ms int, topics string, build boolean"
    calls = spark.createDataFrame([(1, datetime(2024, 1, 30), 5, '["a", "b"]', True), (2, datetime(2024, 1, 30), 0, '["b"]', False), (3, datetime(2024, 1, 30), 9, "{bad", None), (4, datetime(2023, 1, 1), 7, '["old"]', True)], call)
    beats = spark.createDataFrame([(1, datetime(2024, 1, 30), "store", "alive"), (2, datetime(2024, 1, 30), "model", "dead")], "id long, ts timestamp, component string, status string")
    lost = spark.createDataFrame([], "id long, ts timestamp, reason string")
    path = telemetry.write_weekly(telemetry.weekly_report(calls, beats, lost, F.lit(now), {"Build": F.col("build")}, "summary"), f"file://{tmp_path}/r", now)
    assert path.endswith("/2024-05.md")
    text = Path(path.removeprefix("file://")).read_text()
    assert text.split("\n")[3:] == ["## Wrapper", "- Wrapper invocations: 3", "- Build: 1", "- Retrieval latency p50/p95: 9 / 9 ms", "", "## Embed vector leg", "- Degradation events (search fell back to BM25-only): 0", "", "## Top topics triggering warnings", "- b: 2", "- a: 1", "", "## Component health (heartbeat samples)", "- store: alive=1/1 degraded=0 dead=0", "- model: alive=0/1 degraded=0 dead=1  WARN: degraded/dead samples in window"]
    later = telemetry.weekly_report(calls.where("id > 9"), beats.where("id > 9"), None, F.lit(now), {"Build": F.col("build")}, "summary")
    assert telemetry.write_weekly(later, f"file://{tmp_path}/r", now) == path
    text = Path(path.removeprefix("file://")).read_text()
    assert "Embed" not in text and "Top topics" not in text and text.endswith("\n\n(no telemetry rows in the window)")


def test_versions_and_regrade_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "plain", "doc", "user", True, False, 5, None), (2, "plain", "doc", None, True, False, 5, "m"), (3, "<system-reminder>x", "doc", "user", False, False, 0, "m"), (4, "<system-reminder>x", None, "user", False, True, 0, "m")], "id long, content string, source string, role string, is_correction boolean, is_decision boolean, signal_weight int, module string")
    done = capture.regrade(rows, F.lit(None).cast("string"), F.when(F.col("id") == 1, "p"))
    assert {r["id"]: r["changed"] for r in done.collect()} == {1: True, 2: True, 3: False, 4: True}
    counts = {r["source"]: tuple(r)[1:] for r in capture.regrade_counts(done).collect()}
    assert counts == {None: (1, 1, 1, 1), "doc": (1, 0, 1, 1), "": (0, 1, 0, 0)}
    path = capture.save_version(rows, str(tmp_path / "chunks"), "before")
    with pytest.raises(AnalysisException):
        capture.save_version(done, str(tmp_path / "chunks"), "before")
    assert spark.read.parquet(path).count() == 4


def test_hash_of_a_block(spark):
    blocks = ["a\nmemory-health (1): ok\nb", "a\r\nb\n", "a\nb", "a\nmemory-healthy\nb", "a\n memory-health\nb"]
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string").orderBy("i").select(health.stable_hash(F.col("b"))).collect()]
    assert got[0] == got[1] == got[2] and len({*got}) == 3
