"""Mining of growing logs: any split of the runs gives what one pass gives; nothing is repeated."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
import pytest

from memspark.sources import appended, keyed_rows
from memspark.streaming import mining

LONG = "and this part makes the sentence long enough to pass the gate"
TURNS = {
    "a": [("user", f"We decided to use the ring {LONG}. Nothing."), ("assistant", "I wrote a plan for gate_kernel."), ("user", "No, you missed the old one."), ("user", "you missed it again"), ("assistant", f"The old way was rejected {LONG}."), ("user", "<system-reminder> you missed"), ("user", f"We decided to use the ring {LONG}.")],
    "b": [("assistant", f"Let's go with plan {i} {LONG}.") for i in range(30)] + [("user", "we tried that"), ("assistant", None), ("user", "you missed that")],
}


def line(role, text):
    return json.dumps({"timestamp": "2024-01-05T00:00:00", "message": {"role": role, "content": text}}) + "\n"


def data(name: str) -> bytes:
    return "".join(line(r, t) if t is not None else '{"broken": \n' for r, t in TURNS[name]).encode()


def by_hand():
    """(session, kind, place or tick, title or text, context) in one pass."""
    out = set()
    for s in TURNS:
        at, last, seen, n = 0, (None, ""), set(), {"decision": 0, "dead_end": 0}
        for role, text in TURNS[s]:
            start, at = at, at + len(line(role, text) if text is not None else '{"broken": \n')
            if text is None:
                continue
            harness = text.startswith("<system-reminder>")
            if role == "user" and last[0] == "assistant" and not harness and any(p in text.lower() for p in ("you missed", "we tried that")):
                out.add((s, "correction", start, text, last[1]))
            last = (role, text)
            for kind, cues in (("decision", ("we decided", "let's go with")), ("dead_end", ("rejected",))):
                for sentence in [] if harness else [x if x.endswith(".") else x + "." for x in text.split(". ")]:
                    if any(c in sentence.lower() for c in cues) and (kind, sentence) not in seen and n[kind] < 25:
                        seen.add((kind, sentence))
                        n[kind] += 1
                        out.add((s, kind, n[kind], sentence, None))
    return out


def result(frame):
    rows = [(r.session_id, r.kind, r.tick if r.kind == "correction" else r.place, r.text if r.kind == "correction" else r.title, r.context) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("cuts", [[], [250], [90, 1_000, 2_222]])
def test_runs_over_growing_logs_give_what_one_pass_gives(spark, tmp_path, cuts):
    folder = tmp_path / "logs"
    folder.mkdir()
    got = None
    for cut in [*cuts, None]:
        for s in TURNS:
            (folder / f"{s}.jsonl").write_bytes(data(s)[:cut])
        got = mining.mine(spark, f"file://{folder}", f"file://{tmp_path}/state", {"from": "start"})
    assert result(got) == by_hand()
    assert {r.topic for r in got.where("kind = 'correction' and session_id = 'a'").collect()} == {"gate_kernel"}
    again = mining.mine(spark, f"file://{folder}", f"file://{tmp_path}/state", {"from": "start"})
    assert result(again) == by_hand()


def test_the_first_sight_anchors_at_the_end(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_bytes(data("a"))
    assert mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state").count() == 0
    (tmp_path / "logs/a.jsonl").write_bytes(data("a") + line("assistant", "another plan").encode() + line("user", "you missed this").encode())
    assert [r.text for r in mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state").collect()] == ["you missed this"]


def test_a_killed_batch_repeats_nothing(spark, tmp_path):
    """The last batch's commit is lost after its rows were published: the next run runs it again."""
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_bytes(data("a"))
    mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state", {"from": "start"})
    commits = sorted((tmp_path / "state/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "state/checkpoint/commits").glob(".*.crc"):
        crc.unlink()
    again = mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state", {"from": "start"})
    assert result(again) == {x for x in by_hand() if x[0] == "a"}
    assert len(list((tmp_path / "state/checkpoint/commits").glob("[0-9]*"))) == len(commits)
    (tmp_path / "logs/b.jsonl").write_bytes(data("b"))
    assert result(mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state", {"from": "start"})) == by_hand()


def test_runs_admit_so_many_bytes(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for s in TURNS:
        (tmp_path / f"logs/{s}.jsonl").write_bytes(data(s))
    options = {"from": "start", "run_bytes": "1500", "bytes": "800", "order": "b.jsonl"}
    counts = [mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state", {**options, **stop}).count() for stop in ({"run_bytes": "0"}, {"seconds": "0"})]
    while len(counts) < 4 or counts[-1] != counts[-2]:
        got = mining.mine(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state", options)
        if len(counts) == 2:
            assert {r.session_id for r in got.collect()} == {"b"}
        counts.append(got.count())
    assert counts[:2] == [0, 0]
    assert counts[2] < counts[3]
    assert result(got) == by_hand()


def test_admission_is_by_priority_and_deadline():
    sizes = {"/x/doc.jsonl": 50, "/x/memory/m.jsonl": 30, "/x/ledger.jsonl": 20, "/x/z.jsonl": 5}
    order = ["/memory/", "ledger", "doc"]
    assert appended.admitted({}, sizes, order, None) == sizes
    assert set(appended.admitted({"/x/doc.jsonl": 10}, sizes, order, 0).values()) == {0, 10}
    assert appended.admitted({}, sizes, order, 60) == {"/x/memory/m.jsonl": 30, "/x/ledger.jsonl": 20, "/x/doc.jsonl": 10, "/x/z.jsonl": 0}
    assert appended.admitted({"/x/doc.jsonl": 80}, sizes, order, 0)["/x/doc.jsonl"] == 50, "a file that shrank goes on from its end"
    ticks = iter([1.0, 2.0, 9.0, 9.0])
    assert appended.admitted({}, sizes, order, None, 5, lambda: next(ticks)) == {"/x/memory/m.jsonl": 30, "/x/ledger.jsonl": 20, "/x/doc.jsonl": 0, "/x/z.jsonl": 0}


def test_a_long_line_is_read_back_once(tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "SPAN_BYTES", 10)
    monkeypatch.setattr(appended, "_BACK", 7)
    whole = b"short\n" + b"x" * 500 + b"\nend\n"
    (tmp_path / "s.jsonl").write_bytes(whole)
    reader = appended.AppendedReader({"path": f"file://{tmp_path}", "from": "start"})
    got = [x for s in reader.partitions({}, reader.latestOffset()) for x in reader.read(s)]
    assert [(x[2], x[3]) for x in got] == [("short", 0), ("x" * 500, 6), ("end", 507)]


def test_a_repeated_commit_adds_no_row(spark, tmp_path):
    writer = keyed_rows.KeyedWriter({"path": f"file://{tmp_path}/rows"})
    for batch, values in ((0, [1, 2]), (1, [3]), (1, [3]), (0, [1, 2]), (2, [])):
        parts = [writer.write(iter([pa.RecordBatch.from_pydict({"x": pa.array([v], pa.int64())}) for v in values])), None]
        writer.commit(parts, batch)
    lost = writer.write(iter([pa.RecordBatch.from_pydict({"x": [9]})]))
    assert sorted(r.x for r in keyed_rows.committed(spark, f"file://{tmp_path}/rows", spark.range(1).toDF("x").schema).collect()) == [1, 2, 3]
    assert len(list(Path(tmp_path / "rows/parts").iterdir())) == 3
    writer.abort([lost], 3)
    assert len(list(Path(tmp_path / "rows/parts").iterdir())) == 2
    assert keyed_rows.committed(spark, f"file://{tmp_path}/none", spark.range(1).schema).count() == 0
