"""Rules of gates, caps and nudges on small rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memspark.functions import embed, text as tx
from memspark.operators import capture, health, prompts, relevance, telemetry
from memspark.sources import appended, readers


def test_gate_reads_the_first_32_tokens_only(spark):
    words = [f"token{i}x" for i in range(40)]
    prompt = spark.createDataFrame([(1, " ".join(words))], "prompt_id int, prompt string")
    items = spark.createDataFrame([(1, words[0] + " " + words[35]), (2, words[0] + ", " + words[31]), (3, f"use_{words[0]} {words[1]}")], "item_id int, item_text string")
    idfs = spark.createDataFrame([(w, 7.5, 1000) for w in words], "term string, idf double, n_docs int")
    got = {r.item_id: (r.n_matched, r.passed) for r in relevance.lineage_gate(prompt, items, idfs).collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (1, False)}
    assert {r.item_id: r.passed for r in relevance.item_gate(prompt, items, idfs).collect()} == {1: False, 2: True, 3: False}


def test_null_sessions_have_no_cap(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "s", "x") for i in range(10)], "n int, session_id string, item string")
    got = telemetry.damped(rows, ["session_id", "item"], ["n"], 2).collect()
    assert sorted(r.n for r in got) == [0, 1, 2, 3, 5, 7, 9] and {r.delivery for r in got if r.session_id is None} == {None}


def test_post_nudges_show_each_item_once_in_a_session(spark):
    calls = spark.createDataFrame([(i, "s" if i < 4 else "t", i) for i in range(6)] + [(9, None, 9)], "call_id int, session_id string, pos int")
    near = {0: [7, 8], 1: [7, 8], 2: [7, 8], 3: [5], 4: [7], 5: [6, 7], 9: [7]}
    hits = spark.createDataFrame([(c, x, 0.5, r) for c, xs in near.items() for r, x in enumerate(xs)], "call_id int, id int, final_score double, rank int")
    told = spark.createDataFrame([("s", 5)], "session_id string, id int")
    seen, want = {("s", 5)}, set()
    for c in sorted(near):
        s = "s" if c < 4 else "t" if c < 6 else None
        new = next((x for x in near[c] if s and (s, x) not in seen), None)
        if new is not None:
            seen.add((s, new))
            want.add((s, c, new))
    assert {tuple(r) for r in prompts.post_nudges(hits, calls, told).collect()} == want


def beats(spark, now, **hooks):
    rows = [(h, ok, None if age is None else now - timedelta(seconds=age)) for h, (ok, age) in hooks.items()]
    latest = spark.createDataFrame(rows, "hook string, last_ok boolean, newest_success timestamp")
    clock = spark.createDataFrame([(now,)], "now timestamp")
    r = health.heartbeats(latest, clock, ["p", "t"], "start", "end", ["cap"]).first()
    return r.ok, r.detail, r.notes


def test_heartbeat_rules(spark):
    now, day = datetime(2024, 1, 10, 12), 86400
    fine = {"p": (True, 60), "t": (True, 60), "start": (True, 3600), "end": (True, 4000), "cap": (True, 3990)}
    assert beats(spark, now, **fine) == (True, "all 5 hooks consistent", "")
    assert beats(spark, now, **fine | {"t": (True, 3 * day)})[1] == "t:stale"
    assert beats(spark, now, **{k: v for k, v in fine.items() if k != "p"})[1] == "p:no-rows"
    assert beats(spark, now, **fine | {"cap": (False, 3990)})[1] == "cap:latest-errored"
    # A session that lives for days is no fault; one that ended and was followed by turns is.
    long = fine | {"start": (True, 5 * day), "end": (True, 6 * day), "cap": (True, 6 * day)}
    assert beats(spark, now, **long) == (True, "all 5 hooks consistent", "long-lived session")
    dead = fine | {"start": (True, 5 * day), "end": (True, 7200), "cap": (True, 7200)}
    assert beats(spark, now, **dead)[1] == "start:boundary-cycle-without-start"
    assert beats(spark, now, **dead | {"end": (True, 300), "cap": (True, 300)})[0]
    # The end's family, both ways, and what is too young to tell.
    assert beats(spark, now, **fine | {"end": (True, 8000), "cap": (True, 40_000)})[1] == "cap:missed-boundary"
    assert beats(spark, now, **fine | {"end": (True, 40_000), "cap": (True, 8000)})[1] == "end:missed-boundary"
    assert beats(spark, now, **fine | {"end": (True, 1000), "cap": (True, 40_000)})[2] == "cap:pending"
    never = beats(spark, now, p=(True, 1), t=(True, 1))
    assert never[0] and "no session boundary observed yet" in never[2]


def test_a_check_that_fails_is_red(spark):
    good = lambda: spark.createDataFrame([("good", True, "fine")], "name string, ok boolean, detail string")
    got = {r.name: r for r in health.run_gate(spark, {"good": good, "bad": lambda: spark.read.parquet("/nowhere")}).collect()}
    assert got["good"].ok and not got["bad"].ok and got["bad"].n_red == 1


def test_index_anchor(spark):
    files = spark.createDataFrame([("a.md", datetime(2024, 1, 1)), ("b.md", datetime(2024, 1, 9))], "name string, mtime timestamp")
    now = F.lit(datetime(2024, 1, 10))

    def detail(text):
        return health.index_health(spark.createDataFrame([(text,)], "text string"), files, now, "## NOW", 5, 100).first().detail

    assert detail("x](a.md)\n## NOW\n[b](dir/b.md)\n") == "3 lines, 30 bytes"
    assert detail("## NOW\n[a](a.md)") == "anchor old" and detail("## NOW\n[a](c.md)") == "anchor missing" and detail("[b](b.md)") == "no anchor"
    assert detail("## NOW\n[b](b.md)\n" + "\n" * 9) == "too many lines"


def test_windows_of_messages_resume(spark):
    rows = [("s", 1, "assistant", "a plan"), ("s", 2, "assistant", None), ("s", 3, "user", "you missed the gate_kernel"), ("s", 4, "assistant", "sorry"), ("s", 5, "user", "<system-reminder> you missed"), ("s", 6, "user", "you missed it")]
    m = spark.createDataFrame(rows, "session_id string, tick bigint, role string, text string")
    whole = capture.resume_corrections(m, m.where("false"))[0].collect()
    assert [(r.tick, r.topic, r.assistant_message) for r in whole] == [(3, "gate_kernel", "a plan")]
    for cut in range(1, 6):
        first, carried = capture.resume_corrections(m.where(f"tick <= {cut}"), m.where("false"))
        second, _ = capture.resume_corrections(m.where(f"tick > {cut}"), carried)
        assert sorted(first.union(second).collect()) == sorted(whole)


def test_spans_cut_large_files_and_keep_returns(tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "SPAN_BYTES", 7)
    lines = ["one", "a\rb", "", "a much longer line than a span", "end"]
    (tmp_path / "s.jsonl").write_bytes("".join(x + "\n" for x in lines).encode() + b"partial")
    reader = appended.AppendedReader({"path": str(tmp_path), "from": "start"})
    spans = reader.partitions({}, reader.latestOffset())
    got = [x for s in spans for x in reader.read(s)]
    assert [x[2] for x in got] == lines and len(spans) > 5
    assert [x[1] for x in got] == [sum(len(x) + 1 for x in lines[: i + 1]) for i in range(len(lines))]


def test_providers_are_called_by_the_batch(spark):
    class Batched:
        dim = 2

        def embed_batch(self, texts):
            if "bad" in texts:
                raise RuntimeError("down")
            return [[1.0, float(len(t))] for t in texts]

        def embed(self, text):
            if text == "bad":
                raise RuntimeError("down")
            return [2.0, float(len(text))]

    rows = spark.createDataFrame([("a", 1), ("bb", 2)], "t string, embedding int")
    assert sorted(r.embedding for r in embed.with_embedding(rows, "t", Batched()).collect()) == [[1.0, 1.0], [1.0, 2.0]]
    mixed = embed.with_embedding(spark.createDataFrame([("a",), ("bad",)], "t string").coalesce(1), "t", Batched()).collect()
    assert [r.embedding for r in mixed] == [[2.0, 1.0], None] and mixed[1].embed_error == "RuntimeError: down"


def test_budget_leaves_sources_for_the_next_run(spark):
    ticks, done = iter([0.0, 0.0, 5.0, 11.0]), []
    left = readers.in_order([(n, None) for n in ("memory", "ledger", "session")], 10.0, lambda: next(ticks), lambda n, _: done.append(n))
    assert done == ["memory", "ledger"] and left == ["session"]


def test_ages_and_paths(spark):
    ages = spark.createDataFrame([(300_000.0,), (18_360.0,), (250.0,)], "s double").select(tx.format_age(F.col("s")).alias("a"))
    assert [r.a for r in ages.collect()] == ["3.5d", "5.1h", "4m"]
    paths = spark.createDataFrame([("docs/Gate/notes.md",), ("docs/x/loop.md",), ("src/gate/a.md",), ("docs/states/kernel.state.yaml",)], "p string")
    got = [r.m for r in paths.select(tx.module_of_path(F.col("p"), ["gate", "loop"], ["docs/"]).alias("m")).collect()]
    assert got == ["gate", "loop", None, "kernel"]


SF = "/root/testdata/sf0.001"


def test_stemmed_terms_query_against_plain_python(spark):
    import regex

    from memspark.functions.stem import stem
    from memspark.jobs import more
    from memspark.session import table

    want: dict[str, int] = {}
    for r in table(spark, SF, "conversations").collect():
        for s in {stem(t) for t in regex.split(r"[^\p{L}\p{N}\p{Co}\p{M}]+", r.text.lower()) if t}:
            want[s] = want.get(s, 0) + 1
    assert {r.stem: r.df for r in more.d3_bm25_stemmed_terms(spark, SF).collect()} == want


def test_embed_query_against_the_provider(spark):
    from memspark.jobs import more
    from memspark.session import table

    texts = {(r.conv_id, r.turn): r.text for r in table(spark, SF, "conversations").collect()}
    provider = embed.HashEmbedder(32)
    got = more.m1_embed(spark, SF).collect()
    assert len(got) == len(texts) and all(r.embed_error is None for r in got)
    for r in got[:20]:
        assert max(abs(a - b) for a, b in zip(r.embedding, embed.embed_one(provider, texts[r.conv_id, r.turn]), strict=True)) < 1e-6


def test_post_nudge_query_against_a_loop(spark):
    from memspark.jobs import flows

    calls = {r.call_id: (r.session_id, r.pos) for r in flows._calls(spark, SF).collect()}
    near: dict = {}
    for r in flows._nudge_hits(spark, SF).orderBy("call_id", "rank").collect():
        near.setdefault(r.call_id, []).append(r.id)
    seen = {(calls[c][0], x) for c, xs in near.items() for x in xs if x % 10 == 0}
    want = set()
    for c in sorted(near, key=lambda c: calls[c][1]):
        new = next((x for x in near[c] if (calls[c][0], x) not in seen), None)
        if new is not None:
            seen.add((calls[c][0], new))
            want.add((calls[c][0], c, new))
    got = {tuple(r) for r in flows.k8_post_nudges(spark, SF).collect()}
    assert got == want
