"""Readers and text functions on small files and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import classify, text as tx
from memspark.operators import capture, relevance, search
from memspark.sources import readers


def test_sessions(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"type":"user","message":{"content":"hi"}}\n\nnot json\n{"message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool","text":"x"},{"type":"text","text":"b"}]}}\n{"message":{"role":"user","content":"  "}}\n')
    got = {(r.session_id, r.role, r.text) for r in readers.sessions(spark, str(tmp_path)).collect()}
    assert got == {("s1", "user", "hi"), ("s1", "assistant", "ab")}
    mined = {r.text for r in readers.messages(spark, str(tmp_path)).collect()}
    assert "a\nx\nb" in mined and None in mined


def test_markdown_and_memory(spark, tmp_path):
    (tmp_path / "m.md").write_text("---\ntype: invariant\nname: rule\n---\n# Title\nlead\n## One\nbody\n### Two\nmore\n")
    parts = readers.markdown_sections(spark, str(tmp_path)).orderBy("line_start").collect()
    assert [(p.line_start, p.line_end) for p in parts] == [(1, 6), (7, 8), (9, 10)]
    memory = readers.memory_files(spark, str(tmp_path)).collect()
    assert memory[0].meta == {"type": "invariant", "name": "rule"} and len(memory) == 3
    assert [tuple(r) for r in readers.invariants(spark, str(tmp_path)).collect()] == [("m.md", "Title")]


def test_long_sections_keep_line_bounds(spark):
    text = "## A\n" + "\n".join("x" * 9 for _ in range(10))
    rows = tx.split_sections(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", window=40).orderBy("part").collect()
    assert "".join(r.text for r in rows) == text
    assert [(r.line_start, r.line_end) for r in rows] == [(1, 5), (5, 9), (9, 11)]


def test_progress_git_and_rosters(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.jsonl").write_text('{"step":"1","coverage":[1,2]}\nbroken\n{"step":"2","coverage":[1,2,3]}\nbroken\n')
    assert readers.progress(spark, str(tmp_path / "p")).collect()[0].coverage == 3
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "log").write_text("\x1ea1\tAnn\t2024-01-01\tsubject\nbody text\n\x1eb2\tBob\t2024-01-02\tonly\n")
    got = sorted((r.sha, r.text) for r in readers.git_log(spark, str(tmp_path / "g")).collect())
    assert got == [("a1", "subject\n\nbody text"), ("b2", "only")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "alpha.state.yaml").write_text("do_not_rebuild: false\ndo_not_rebuild: true\n")
    (tmp_path / "r" / "beta.state.yaml").write_text("config_flag: use_beta\n")
    assert sorted(tuple(r) for r in readers.rosters(spark, str(tmp_path / "r")).collect()) == [("alpha", True), ("use_beta", False)]


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.collapse_ws(F.col("t")), t=" a  b\x1cc \n") == "a b c"
    assert one(spark, tx.clip(F.col("t"), 8), t="alpha beta gamma") == "alpha…"
    assert one(spark, tx.clip(F.col("t"), 0), t="alpha") == ""
    assert one(spark, tx.first_sentence(F.col("t")), t="One two. Three!") == "One two."
    assert one(spark, tx.derive_aliases(F.col("t")), t="the GW and a causal world model") == "cwm | global workspace"
    assert one(spark, tx.derive_aliases(F.col("t")), t="gw only") == ""
    assert one(spark, tx.detect_module(F.col("t"), ["beta", "alpha"]), t="use_alpha then beta") == "alpha"
    assert one(spark, tx.extract_topic(F.col("t")), t="Look at the memory_gate and use_x") == "memory_gate"
    assert one(spark, tx.extract_topic(F.col("t")), t="already wrong widget") == "widget"
    assert one(spark, tx.extract_symbols(F.col("t")), t="see src/a/b.py, use_it and one_two_three") == ["src/a/b.py", "use_it", "one_two_three"]
    assert one(spark, tx.slug(F.col("t")), t="Ünï  Code!!x") == "ünï-code-x"
    assert one(spark, tx.significant_tokens(F.col("t")), t="The GW should route-plan with plan") == ["gw", "route", "plan"]
    assert one(spark, tx.word_match(F.col("w"), F.col("t")), w="apollo", t="use_apollo apollo2") is False


def test_classifiers(spark):
    assert one(spark, classify.harness_reason(F.col("t")), t="  hook success: x") == "hook_stdout"
    assert one(spark, classify.harness_reason(F.col("t")), t="quoting a hook success here") is None
    weight = classify.signal_weight(F.col("t"), F.col("r"))
    assert [one(spark, weight, t=t, r=r) for t, r in (("We already built it", "user"), ("root cause found", "user"), ("please diagnose", "user"), ("ok", "user"), ("the fix is x", "assistant"), ("ok", "assistant"), ("ok", "doc"))] == [100, 50, 30, 10, 20, 0, 20]
    assert one(spark, classify.build_intent(F.col("t")), t="it was built") is False
    assert one(spark, classify.build_intent(F.col("t")), t="let's build it") is True
    assert one(spark, classify.gate_reason(F.col("t")), t="All four locked in.") == "status_echo"
    assert one(spark, classify.is_curated_correction(F.col("t")), t="/m/FEEDBACK_x.md") is True


def test_corrections_and_candidates(spark):
    rows = [("s", 0, "assistant", "I will write the memory_gate."), ("s", 1, "user", None), ("s", 2, "user", "We already built that."), ("s", 3, "user", "you missed it"), ("s", 4, "assistant", "We decided to keep the hashing join for every incremental run of the importer. Approved.")]
    m = spark.createDataFrame(rows, "session_id string, pos int, role string, text string")
    assert [(r.pos, r.topic) for r in capture.correction_events(m).collect()] == [(2, "memory_gate")]
    found = capture.candidates(m).collect()
    assert [(r.kind, r.pos) for r in found] == [("decision", 4)]


def test_bm25_phrase_and_degraded_search(spark):
    docs = spark.createDataFrame([(1, "use apollo now"), (2, "apollo use"), (3, "nothing here")], "id int, content string")
    q = spark.createDataFrame([(0, '"use_apollo"', None)], "query_id int, query string, vector array<float>")
    got = search.bm25(docs, spark.createDataFrame([(0, "use_apollo")], "query_id int, query string"), 5).collect()
    assert [r.id for r in got] == [1]
    vectors = spark.createDataFrame([(1, [0.1, 0.2])], "chunk_id int, embedding array<float>")
    rows = search.hybrid(docs.withColumn("signal_weight", F.lit(0)), vectors, q.withColumn("query", F.lit("apollo")), 2).orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1] and rows[0].final_score > rows[0].fusion_score


def test_gate_small_corpus(spark):
    docs = spark.createDataFrame([(i, "filler words here") for i in range(10)], "id int, content string")
    prompts = spark.createDataFrame([(0, "filler words please")], "prompt_id int, prompt string")
    items = spark.createDataFrame([(7, "some filler words"), (8, "filler")], "item_id int, item_text string")
    idfs = relevance.token_idf(docs, prompts.select(F.explode(tx.prompt_tokens(F.col("prompt"))).alias("term")), "content")
    assert {(r.item_id, r.passed) for r in relevance.lineage_gate(prompts, items, idfs).collect()} == {(7, True), (8, False)}


def test_stems():
    from memspark.functions.stem import stem

    # Examples of the paper.
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}.items():
        assert stem(word) == want, word


def test_embedding_failures_are_rows(spark):
    from memspark.functions import embed

    class Narrow(embed.HashEmbedder):
        def embed(self, text):
            if "bad" in text:
                raise RuntimeError("no")
            if len(text) > 2_000:
                raise embed.TooLong
            return super().embed(text)

    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "x " * 20_000)], "id int, text string")
    got = {r.id: r for r in embed.with_embedding(rows, "text", Narrow(8)).collect()}
    assert got[2].embedding is None and got[2].embed_error.startswith("RuntimeError")
    assert len(got[1].embedding) == 8 and got[3].embed_error is None


def test_appended_lines(spark, tmp_path):
    from memspark.sources.appended import AppendedReader

    log = tmp_path / "s1.jsonl"
    log.write_bytes(b"one\ntwo\npar")
    reader = AppendedReader({"path": f"file://{tmp_path}", "from": "start"})

    def lines(start, end):
        return [x for p in reader.partitions(start, end) for x in reader.read(p)]

    a = reader.latestOffset()
    assert [(f, v) for f, _, v, _ in lines(reader.initialOffset(), a)] == [("s1", "one"), ("s1", "two")]
    with log.open("ab") as f:
        f.write(b"tial\nlast\n")
    b = reader.latestOffset()
    assert [(at, e, v) for _, e, v, at in lines(a, b)] == [(8, 16, "partial"), (16, 21, "last")]
    assert lines(b, b) == []
    assert AppendedReader({"path": f"file://{tmp_path}"}).initialOffset() == b


def test_stream_of_appended_lines(spark, tmp_path):
    from memspark.sources.appended import AppendedLines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.jsonl").write_text("a\nb\n")
    spark.dataSource.register(AppendedLines)
    stream = spark.readStream.format("appended_lines").option("from", "start").load(f"file://{tmp_path}/in")
    q = stream.writeStream.format("memory").queryName("appended").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.table("appended").collect()) == ["a", "b"]
