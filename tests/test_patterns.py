"""Many patterns in one pass, circuits, and novel items of streamed sessions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from memspark.functions import embed
from memspark.operators import capture, patterns, prompts
from memspark.streaming import jobs


def like_pairs(texts, asked):
    hit = F.like(F.lower("content"), F.concat(F.lit("%"), F.lower("pattern"), F.lit("%")))
    return {(r.id, r.pattern) for r in texts.join(asked.distinct(), hit).select("id", "pattern").collect()}


def test_one_pass_finds_what_like_finds(spark):
    rnd = random.Random(2)
    words = ["gate", "gate_kernel", "GateXKernel", "flag", "ünï", "100%", "a_b", "end\nline", "\\", "𝔘x"]
    texts = spark.createDataFrame([(i, "".join(rnd.choice([*words, " ", "-"]) for _ in range(rnd.randrange(0, 9)))) for i in range(150)] + [(500, None), (501, ""), (502, "x" * 100_000 + " gate1kernel")], "id int, content string")
    asked = spark.createDataFrame([(p,) for p in ["gate_kernel", "GATE", "flag", "_", "___", "", "%", "g%k", "ÜNÏ", "100\\%", "a\\_b", "d_l", "\\\\", "𝔘_", "absent", "flag", None]], "pattern string")
    want = like_pairs(texts, asked)
    assert {(r.id, r.pattern) for r in patterns.matches(texts, asked).collect()} == want
    assert {(r.id, r.pattern) for r in patterns.matches(texts, asked, chunk=3).collect()} == want
    assert patterns.matches(texts, asked.limit(0)).count() == 0
    assert patterns.matches(texts.limit(0), asked).count() == 0


def test_boosts_need_no_nested_loop(spark):
    chunks = spark.createDataFrame([(1, "the gate1kernel", 10), (2, "nothing", 90), (3, "gate_kernel use_flag", 90)], "id int, content string, w int")
    topics = spark.createDataFrame([("gate_kernel",), ("gate_kernel",), ("use_flag",), ("",)], "topic string")
    out = capture.topic_boost(chunks, topics, "content", "w")
    assert {(r.id, r.n_boosts, r.boosted) for r in out.collect()} == {(1, 2, 50), (2, 0, 90), (3, 3, 100)}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_time_does_not_grow_with_the_patterns():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(9))
    text = " ".join(word() for _ in range(20_000))
    seconds = []
    for n in (100, 20_000):
        m = patterns.Matcher([word() for _ in range(n)])
        began = time.perf_counter()
        m.found(text)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 20 * seconds[0] + 0.05


def test_a_circuit_opens_waits_and_closes():
    now, asked = [0.0], []

    def dead():
        asked.append(now[0])
        raise ConnectionError("down")

    c = embed.Circuit(10, lambda: now[0])
    assert c.call(dead) == (None, "ConnectionError: down", True)
    now[0] = 5
    assert c.call(dead) == (None, "ConnectionError: down", False)
    assert c.state == "open"
    now[0] = 12
    assert c.state == "half open"
    assert c.call(dead) == (None, "ConnectionError: down", False)
    now[0] = 23
    assert c.call(lambda: [1.0]) == ([1.0], None, False)
    assert c.state == "closed"
    assert asked == [0.0, 12]


def test_a_dead_endpoint_costs_a_worker_one_call(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Dead:
        dim, endpoint = 2, "http://dead.example/one"

        def embed(self, text):
            with open(calls, "a") as f:
                f.write("x")
            raise ConnectionError("down")

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id int, t string").repartition(1)
    done, degraded = embed.guarded_embedding(rows, "t", Dead())
    assert {(r.embedding, r.embed_error) for r in done.collect()} == {(None, "ConnectionError: down")}
    assert [tuple(r) for r in degraded.collect()] == [("search", "http://dead.example/one", "ConnectionError: down")]
    assert (tmp_path / "calls").read_text() == "x"
    fine, none = embed.guarded_embedding(rows, "t", embed.HashEmbedder(4))
    assert none.count() == 0
    assert fine.where("embed_error is null and size(embedding) = 4").count() == 200


NEAR = "session_id string, pos int, call_id int, near array<struct<rank: int, id: bigint>>"


@pytest.fixture
def no_empty_batches(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_streamed_novelty_equals_the_fold(spark, tmp_path, no_empty_batches):
    rnd = random.Random(4)
    rows = [(rnd.choice(["s", "t", None]), i, i, [(r, x) for r, x in enumerate(rnd.sample(range(8), 3))]) for i in range(40)]
    hits = spark.createDataFrame([(c, r, x) for _, _, c, near in rows for r, x in near], "call_id int, rank int, id bigint")
    calls = spark.createDataFrame([(c, s, p) for s, p, c, _ in rows], "call_id int, session_id string, pos int")
    want = {tuple(r) for r in prompts.post_nudges(hits, calls, spark.createDataFrame([], "session_id string, id bigint")).select("session_id", "call_id", "id").collect()}
    for k, cuts in enumerate(([40], [13, 40], [1, 2, 30, 40])):
        folder, at = tmp_path / f"in{k}", 0
        for cut in cuts:
            spark.createDataFrame(rows[at:cut], NEAR).coalesce(1).write.mode("append").parquet(str(folder))
            at = cut
            stream = spark.readStream.schema(NEAR).parquet(str(folder))
            q = jobs.first_novel_stream(stream, 3_600_000).writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", f"file://{tmp_path}/c{k}").trigger(availableNow=True).start()
            assert q.awaitTermination(60)
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / f"out{k}")).select("session_id", "call_id", "id").collect()} == want


def test_what_was_shown_expires(spark, tmp_path, no_empty_batches):
    folder = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([("s", i, i, [(0, 7)])], NEAR).coalesce(1).write.mode("append").parquet(folder)
        q = jobs.first_novel_stream(spark.readStream.schema(NEAR).parquet(folder), 500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        time.sleep(1)
    assert sorted(r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]
