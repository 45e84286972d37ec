"""The ten operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from memspark.llm import langid, mixing, neighbours, pieces, quality, repeats, simhash, sketch, token_files, toxicity
from memspark.llm.registry import tokenizer_path
from memspark.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n\t ", None, "a", 1),
    (None, "null id with some words in it", "de", "a", 5),
    (5, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "a", 1),
    (6, "word " * 30_000, "en", "b", 150_000),
    (6, "another text of a repeated id", "fr", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


# 1 SimHash


def fingerprint(t: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, SF, "documents")).collect()}
    fp = {d: fingerprint(t) for d, t in texts}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fp
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fp, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {d: r.component_id for d, r in got.items()} == {d: find(d) for d in fp}


@pytest.mark.parametrize("longest", [0, 2, 32])
def test_links_are_whole_in_long_lists(spark, longest):
    rng = random.Random(1)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(4))) for _ in range(60)} | {rng.getrandbits(63) for _ in range(40)}
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), longest).collect()
    root = {p: p for p in prints}

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    want = dict(root)
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(want, a), find(want, b)
            want[max(x, y)] = min(x, y)
    for e in edges:
        assert (e.u ^ e.v).bit_count() <= 2
        x, y = find(root, e.u), find(root, e.v)
        root[max(x, y)] = min(x, y)
    assert {p: find(root, p) for p in prints} == {p: find(want, p) for p in prints}


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert {(r.fingerprint, r.component_id) for r in empty} == {("0" * 16, 2)}
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one_of_each(spark, odd, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    far = [w if rng.random() > 0.3 else "x" for w in base]
    rows = [(9, " ".join(near)), (3, " ".join(base)), (4, " ".join(base)), (5, " ".join(far)), (6, "short one")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6]
    got = simhash.keep_one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 1, 2, 6, 6]
    assert simhash.keep_one_of_each(none).count() == 0


def test_keep_one_of_each_tells_rows_apart_by_id_and_text(spark, odd):
    assert sorted(r.doc_id or -1 for r in simhash.keep_one_of_each(odd).collect()) == [-1, 1, 2, 6, 6]
    rng = random.Random(6)
    many = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(8)]
    rows = [(None, t) for t in many[:5]] + [(None, many[0]), (7, many[1] + " more"), (7, many[5]), (7, many[6]), (7, many[6]), (2**63 - 1, many[4]), (0, many[7])]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    want = [(None, many[0]), (7, many[1] + " more"), (None, many[2]), (None, many[3]), (2**63 - 1, many[4]), (7, many[5]), (7, many[6]), (0, many[7])]
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, want))


@pytest.mark.parametrize("longest", [0, 3, 32])
def test_keep_one_of_each_against_brute_force(spark, monkeypatch, longest):
    """Groups of edited copies, some around the threshold, texts that share boilerplate, and texts built of shared sentences."""
    monkeypatch.setattr(simhash, "MAX_POSTING", longest)
    rng = random.Random(12)
    stock = [f"s{i}" for i in range(60)]
    bank = [[f"q{i}w{j}" for j in range(8)] for i in range(30)]
    bodies = []
    for _ in range(6):
        base = [f"b{rng.randrange(9000)}" for _ in range(120)]
        for k in range(25):
            body = list(base)
            for at in rng.sample(range(120), k % 5):
                body[at] = f"e{rng.randrange(10**6)}"
            bodies.append(body)
    bodies += [stock + [f"c{rng.randrange(9000)}" for _ in range(40 + k)] for k in range(30)]
    bodies += [sum(rng.sample(bank, 9), []) for _ in range(60)]
    bodies += [sum((bank[x] for x in range(9) if x != k), []) + bank[9 + k] for k in range(9)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bodies)]
    sets = [{tuple(b[i : i + 5]) for i in range(len(b) - 4)} for b in bodies]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root[:], 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(x) for x in root})


def test_keep_one_of_each_finds_all_copies_in_long_lists(spark, monkeypatch):
    # Every node is under the same few keys, as if the corpus were very large.
    same = F.pandas_udf(lambda s: pd.Series([[0, 1]] * len(s)), "array<bigint>")
    monkeypatch.setattr(simhash, "_wide_keys", same)
    rng = random.Random(8)
    stock = [f"s{i}" for i in range(90)]
    rows, want = [], set()
    for i in range(120):  # 120 different texts with shared boilerplate, each with a near copy
        body = [f"b{rng.randrange(5000)}" for _ in range(110)]
        rows.append((i, " ".join(stock + body)))
        rows.append((1000 + i, " ".join(stock + body[:50] + ["changed"] + body[51:])))
        want.add(i)
    base = [f"c{i}" for i in range(150)]
    for i in range(60):  # a group of near copies that a chain of small changes holds together
        rows.append((2000 + i, " ".join([f"x{k}" for k in range(i)] + base[i:])))
    want.add(2000)
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert {r.doc_id for r in got.collect()} == want


# 2 Neighbours


def test_neighbours_recall(spark):
    e = table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in e.orderBy("vec_id").collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = neighbours.nearest(e, F.col("vec_id") % 50 == 0).collect()
    near: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near.setdefault(r.query_id, []).append(r)
    hit = 0
    for q, rs in near.items():
        cos = u @ u[q]
        cos[q] = -2
        hit += len({r.vec_id for r in rs} & set(np.argsort(-cos, kind="stable")[:5].tolist()))
        assert all(abs(r.score - cos[r.vec_id]) < 1e-12 for r in rs) and [r.rank for r in rs] == [1, 2, 3, 4, 5]
    assert len(near) == 10 and hit / (5 * len(near)) >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    e = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("list", F.lit(1))
    got = sorted(tuple(r) for r in neighbours.nearest(e, F.col("vec_id") % 50 == 0).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 8), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 8)]
    assert neighbours.nearest(e.where("vec_id = 3"), F.lit(True)).count() == 0


def test_neighbours_scaled_copies_and_short_lists(spark, monkeypatch):
    """Many vectors of one direction tie, and queries whose lists are too short go on to the others."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    monkeypatch.setattr(neighbours, "MIN_PROBED", 1)
    monkeypatch.setattr(neighbours, "HELD", 0.0)
    rng = np.random.default_rng(3)
    copies = [(i, [2.0 ** (i % 7), 0.0, 2.0 ** (i % 7), 0.0]) for i in range(0, 120, 2)]
    others = [(i, rng.normal(size=4).tolist()) for i in range(1, 120, 2)]
    e = spark.createDataFrame(copies + others, "vec_id bigint, embedding array<double>").repartition(3)
    got: dict[int, list] = {}
    for r in neighbours.nearest(e, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 120, 10)) and all([r.rank for r in rs] == [1, 2, 3, 4, 5] for rs in got.values())
    assert [r.vec_id for r in got[0]] == [2, 4, 6, 8, 10] and [r.vec_id for r in got[50]] == [0, 2, 4, 6, 8]
    alone = neighbours.nearest(e.where("vec_id in (0, 1, 3)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in alone) == [1, 3]


def test_scan_keeps_what_the_bound_allows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:20] + 0.02 * rng.normal(size=(20, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    at, by = neighbours.scan(q.astype(np.float32), x.astype(np.float32), 6, tile=(7, 500))
    hit = sum(len(set(by[at == i]) & set(np.argsort(-(x @ q[i]))[:6])) for i in range(20))
    assert hit >= 0.95 * 120 and len(at) < 0.05 * 20 * 3000
    # With bounds from before, only what improves on them comes out, equals included.
    sixth = np.sort(2 - 2 * (q @ x[:1500].T), axis=1)[:, 5]
    at, by = neighbours.scan(q.astype(np.float32), x[1500:].astype(np.float32), 6, tile=(7, 500), bounds=sixth)
    assert all(2 - 2 * x[1500 + j] @ q[i] <= sixth[i] + 2e-5 for i, j in zip(at, by, strict=True))
    assert neighbours.scan(q.astype(np.float32), x.astype(np.float32), 6, bounds=np.zeros(20))[0].size == 0


def test_rounds_reach_all_segments():
    assert neighbours.round_ends(5) == [5] and neighbours.round_ends(8) == [8] and neighbours.round_ends(64) == [8, 64]
    for units in range(9, 3000, 7):
        ends = neighbours.round_ends(units)
        assert ends[0] == neighbours.FIRST and ends[-1] == units and all(a < b <= neighbours.WIDER * a + 1 for a, b in zip(ends, ends[1:]))


def cogrouped_rows(spark, since):
    """Rows that came out of cogroups in executions after ``since``, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for run in (runs.apply(i) for i in range(runs.size())):
        if run.executionId() <= since:
            continue
        last, values, nodes = max(last, run.executionId()), store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())) if "CoGroups" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total, last


def test_pairs_of_neighbours_do_not_grow_with_the_lists(spark, monkeypatch):
    """All of 75 lists are probed: a query's pairs are a few for each round, and the nearest are still found."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    monkeypatch.setattr(neighbours, "HELD", 1.0)
    monkeypatch.setattr(neighbours, "MIN_PROBED", 75)
    x = np.random.default_rng(7).normal(size=(600, 16))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    _, since = cogrouped_rows(spark, -1)
    got = neighbours.nearest(e, F.col("vec_id") % 50 == 0).collect()
    pairs, _ = cogrouped_rows(spark, since)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        cos = u @ u[q]
        cos[q] = -2
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-cos)[:5].tolist()))
    assert len(got) == 60 and hit >= 54
    assert 12 * 6 <= pairs <= 3_000


# 3 Toxicity


def test_toxicity(spark, odd, none):
    rng = random.Random(2)
    plain = ["river", "house", "green", "walk", "table", "cloud", "paper", "under"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zorgfool", "zorgling", "zorgbag"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, lab).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert toxicity.score_documents(odd, lab).count() == len(ODD)
    bare = toxicity.score_documents(odd, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert {r.predicted for r in bare} == {0}
    assert toxicity.score_documents(none, lab).count() == 0


def test_kneser_ney_against_brute_force():
    """The models' difference for each character, computed from plain dictionaries of sequences."""
    rng = random.Random(9)
    words = [["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(30)] for _ in range(2)]
    order, shared, d, bits = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT, toxicity._BITS
    full: list[dict] = [{}, {}]
    for y in (0, 1):
        for w in words[y]:
            t = "\x01" * (order - 1) + w + "\x02"
            for i in range(len(w) + 1):
                full[y][t[i : i + order]] = full[y].get(t[i : i + order], 0) + 1
    tables = {order: full}
    for k in range(order - 1, 0, -1):
        lower = []
        for y in (0, 1):
            kinds: dict = {}
            for g, n in tables[k + 1][y].items():
                if n > 0:
                    kinds[g[1:]] = kinds.get(g[1:], 0) + 1
            lower.append(kinds)
        if k == shared:
            both = {g: lower[0].get(g, 0) + lower[1].get(g, 0) for g in {**lower[0], **lower[1]}}
            lower = [both, both]
        tables[k] = lower

    def p(g: str, y: int, k: int) -> float:
        if not k:
            return 1 / (1 << bits)
        g = g[-k:]
        here = {x: n for x, n in tables[k][y].items() if x[:-1] == g[:-1]}
        total = sum(here.values())
        low = p(g, y, k - 1)
        return max(here.get(g, 0) - d, 0) / total + d * len(here) / total * low if total else low

    keys = [toxicity.sequence_keys(w)[0] for w in words]
    every = np.concatenate(keys)
    counts = np.zeros((len(every), 2), np.int64)
    counts[: len(keys[0]), 0] = 1
    counts[len(keys[0]) :, 1] = 1
    model = toxicity.Model(every, counts)
    asked = ["abca", "dd", "abcdab", "c"]
    got = model.difference(toxicity.sequence_keys(asked)[0])
    want = []
    for w in asked:
        t = "\x01" * (order - 1) + w + "\x02"
        want += [np.log(p(t[i : i + order], 1, order) / p(t[i : i + order], 0, order)) for i in range(len(w) + 1)]
    assert np.allclose(got, want, atol=1e-4)
    # A text's two kinds of evidence, from the same sums.
    texts = ["abca 1 dd, ABCDAB c", "c c c dd", "...", None]
    totals, at = {}, 0
    for w in asked:
        totals[w], at = sum(want[at : at + len(w) + 1]), at + len(w) + 1
    for text, (peak, whole) in zip(texts, model.evidence(texts), strict=True):
        said = toxicity.words_of(text)
        assert abs(peak - max((totals[w] / (len(w) + 1 + toxicity.PAD) for w in said), default=0)) < 1e-4
        assert abs(whole - (sum(totals[w] for w in said) / sum(len(w) + 1 for w in said) if said else 0)) < 1e-4


def test_curve_of_two_kinds_of_evidence():
    """The fit against plain gradient descent on the same penalised likelihood."""
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.stack([rng.normal(y * 1.5, 1), rng.normal(y * 0.5, 0.2)], axis=1)
    slopes, offset = toxicity.fit_curve(x, y)
    z = np.concatenate([(x - x.mean(0)) / x.std(0), np.ones((400, 1))], axis=1)
    weight, at = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5, np.zeros(3)
    for _ in range(20_000):
        at -= 0.005 * (z.T @ (weight * (1 / (1 + np.exp(-z @ at)) - y)) + np.array([0.1, 0.1, 0]) * at)
    assert np.allclose(x @ slopes + offset, z @ at, atol=1e-2)
    assert toxicity.fit_curve(x[:5], y[:5])[1] == -7.2


# 4 Pieces


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    own, lib = pieces.PieceCoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    alphabet = [*"abcdefgh", "é", "日", "😀", " ", "\n", "▁", "#", "́", "\x00"]
    cases = [t for _, t in texts] + ["", " ", "  x ", "a▁ b", "ﬁ ａ", "<s></s>", "x" * 700, "the" * 300, "日本語" * 50] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t, ids in zip(cases, own.encode_all(cases), strict=True):
        assert ids.tolist() == lib.encode(t)
        assert list(own.stream("▁" + t.replace(" ", "▁"))) == lib.encode(t) or not t
        assert own.decode(ids) == t.replace("▁", " ")


def test_pieces_odd_rows(odd, none):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.token_digest(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.decoded_equal for r in rows)
    coded = pieces.encode_documents(odd, path)
    back = pieces.decode_documents(coded.withColumnRenamed("text", "was"), path)
    assert all(r.text == (r.was or "") for r in back.collect())
    assert pieces.token_digest(none, path).count() == 0


# 5 Sketches


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def shingles(t: str) -> set[int]:
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
    n, out = min(5, len(h)), set()
    for i in range(len(h) - n + 1 if h else 0):
        s = 42
        for x in h[i : i + n]:
            s = xxhash.xxh64_intdigest(struct.pack("<q", x), s)
        out.add(signed(s))
    return out


def test_sketches(spark, texts):
    got = {r.doc_id: r for r in sketch.edited_pairs(table(spark, SF, "documents")).collect()}
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b = shingles(t), shingles(edited)
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x & (1 << 64) - 1:016X}" for x in sorted(a)[: sketch.K])
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.16
        assert abs(r.distinct_shingles - len(a)) <= 0.4 * len(a)


def test_sketches_merge_and_odd_rows(spark, odd, none):
    rows = spark.createDataFrame([("g", list(range(0, 300, 2))), ("g", list(range(1, 300, 2)))], "k string, s array<bigint>")
    assert sketch.merge_sketches(rows, ["k"], "s", 50).first().s == list(range(50))
    got = sketch.edited_pairs(odd).collect()
    assert len(got) == len(ODD)
    assert {r.n_chars for r in got if r.doc_id == 2} == {0}
    ones = [r for r in got if r.doc_id == 1]
    assert len({r.fingerprint for r in ones}) == 1 and any(r.near_next == 1 for r in ones)
    assert sketch.edited_pairs(none).count() == 0


# 6 Language


def test_language(spark, odd, none):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in got if got[d].held_out]
    assert set(held) == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.9
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert langid.identify(none).count() == 0


def test_language_is_und_without_a_letter(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in ((f"the house and river {i}", "en"), (f"das haus und der fluss {i}", "de"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    odd = [(1000, "½ ² Ⅷ 12", None), (1001, "٣ 9_9 !", "en"), (1002, "½a", None), (1003, "", None), (1004, None, "de"), (1005, "日本", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")).collect()}
    assert [got[i].lang_pred == "und" for i in range(1000, 1006)] == [True, True, False, True, True, False]
    assert all(got[k].lang_pred == lang for k, _, lang in rows)


def test_language_takes_the_nearest_centroid():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(60)) for _ in range(12)]
    idf = np.ones(langid.DIMENSIONS, np.float32)
    units = [langid.unit(langid.ngram_counts(t), idf) for t in texts]
    model = langid.Model(idf, ["x", "x", "y", "y"], np.stack(units[:4]), np.zeros(4))
    for t, (lang, score, _) in zip(texts[4:], model.predict(texts[4:]), strict=True):
        cos = [float(langid.unit(langid.ngram_counts(t), idf) @ u) for u in units[:4]]
        assert lang == "xxyy"[int(np.argmax(cos))] and abs(score - max(cos)) < 1e-5


# 7 Mixing


def test_targets_reshare_what_stops():
    t = mixing.targets({"a": 10, "b": 1000, None: 100})
    assert t["a"] == 20 and t[None] <= 200 and abs(sum(t.values()) - 1.5 * 1110) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_fit_lengths_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), 5)))
        counts = np.array([rng.randrange(1, 5) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 1)
        took = mixing.fit_lengths(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        best = min(abs(s - budget) for s in sums)
        assert abs(int((lengths * took).sum()) - budget) == best


def test_mix(spark, odd, none):
    docs = table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    by: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    assert all(abs(taken - target) <= 0.02 * target for taken, target, _ in by.values())
    assert mixing.mix(odd).count() == len(ODD)
    kept = mixing.mix_rows(odd)
    assert kept.columns == odd.columns
    assert kept.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix(odd).agg(F.sum("taken")).first()[0]
    assert mixing.mix(none).count() == 0


# 8 Token files


def test_token_files(spark, odd, none, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = sorted(token_files.token_table(table(spark, SF, "documents"), path).collect())
    start = 0
    for r, (d, t) in zip(got, texts, strict=True):
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    hard = ["It's A.Test!! ΣΑΣ. İ ǅ a\x1cb <|endoftext|> x<|startoftext|>.y don't'. é. 日本. ½, x2, 2. 'll.", "<|startoftext|>", " ", "a" * 5000]
    for t, ids in zip(hard, token_files.WordCoder(path).encode(hard), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == own.encode(t, add_special_tokens=False).ids
    rows = token_files.token_table(odd, path).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert token_files.token_table(none, path).count() == 0


def test_words_ids_are_the_librarys(monkeypatch):
    """Also of letters that a normal form joins with the mark after them, and when the memory is emptied all the time."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["J\u030cx e\u0301t\u00c9. A\u030angstr\u00f6m", "x\u0130. \u0130\u0130", "Слово, СЛОВО. ёлка!", "\u0149a \u01c5. \u017ft \u212b", "", "a", " \n ", "\t a.b\u00a0c", "Word|> <|endoftext|>. <|ENDOFTEXT|>"]
    rnd = random.Random(4)
    pieces = ["a", "B", "é", "É", "ß", "İ", "ĳ", "Σ", "ς", "я", "\u030c", "1", "'s", "'", ".", "%%", "|", "<|", "\t", "\n", " ", " ", " "]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    got = token_files.WordCoder(path).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    monkeypatch.setattr(token_files, "CHUNK", 64)
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    assert token_files.WordCoder(path).encode(texts) == got


def test_new_words_are_asked_for_together():
    """Words of letters go to the library joined by blanks, each small spelling once."""
    coder = token_files.WordCoder(tokenizer_path("word_bpe_49k.json"))
    asked: list[str] = []

    class Counting:
        def __init__(self, own):
            self.own = own

        def encode(self, text, **how):
            asked.append(text)
            return self.own.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **how)

    coder.coder = Counting(coder.coder)
    coder.encode(["Some words, some WORDS. other Words!", "Other words"])
    assert [t for t in asked if coder.SEPARATOR not in t] == ["some words other"] and "words" not in asked[-1]


def test_token_files_give_equal_sequences(spark, tmp_path):
    import pyarrow.fs as pafs

    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 40) for i in range(20)], "doc_id bigint, text string")
    shards = token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/t", length=64)
    total = 0
    for shard, _, n_ids, before in shards:
        r = token_files.ShardReader(pafs.LocalFileSystem(), f"{tmp_path}/t", shard)
        seen = 0
        for row in range(-(-n_ids // 64)):
            ids, mask = r.sequence(row)
            assert len(ids) == len(mask) == 64
            seen += int(mask.sum())
        assert seen == n_ids and before == total
        total += n_ids


# 9 Quality


def test_quality(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = {r.doc_id: r.quality_ok for r in quality.assess(docs).collect() if r.doc_id in truth}
    good = [got[d] for d in got if truth[d] == 1]
    bad = [got[d] for d in got if truth[d] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    rows = quality.assess(odd).collect()
    assert len(rows) == len(ODD) and not any(r.quality_ok for r in rows if r.doc_id in (2, 3, 4))
    assert quality.assess(none).count() == 0


def test_label_model_learns_votes():
    rng = random.Random(6)
    n: dict[str, int] = {}
    for _ in range(5000):
        bad = rng.random() < 0.2
        p = "".join("b" if rng.random() < (0.7 if bad else 0.02) else "-" for _ in range(3)) + ("g" if rng.random() < (0.1 if bad else 0.9) else "-")
        n[p] = n.get(p, 0) + 1
    m = quality.LabelModel(list(n), np.array(list(n.values())))
    assert abs(m.share - 0.2) < 0.03 and abs(m.rates[1][0, 0] - 0.7) < 0.06 and m.accuracy()[0] > 0.8


# 10 Repeats


def brute(rows: list[tuple[int, bytes]]) -> dict[int, tuple]:
    seen, out = set(), {}
    for d, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - 99):
            s = t[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot,many", [(2000, 16), (2, 1)])
def test_repeats(spark, monkeypatch, hot, many):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefgh é日") for _ in range(rng.randrange(90, 400))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = ["".join(rng.choice("mnopqrst uvü") for _ in range(rng.randrange(0, 200))) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages)[rng.randrange(30) :])
        rows.append((i * 3, "".join(parts)))
    rows += [(900, "na" * 400), (901, "x" * 99), (902, "x" * 101), (903, ""), (904, rows[5][1]), (905, "x" * 2_200_000 + passages[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    small = [r for r in rows if r[0] != 905]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs.where("doc_id <> 905")).collect()}
    assert got == brute([(d, t.encode()) for d, t in small])
    last = next(r for r in repeats.remove_repeats(docs).collect() if r.doc_id == 905)
    assert last.n_removed >= 2_200_000 - 1 and last.n_spans in (1, 2)


def test_suffix_ranks_are_the_order_of_strings():
    rng = random.Random(1)
    for window in (3, 8, 9, 20, 100):
        text = bytes(rng.choice(b"ab") for _ in range(400))
        strings = [text[i : i + window] for i in range(len(text) - window + 1)]
        place = {x: i for i, x in enumerate(sorted(set(strings)))}
        assert repeats.suffix_ranks(text, window).tolist() == [place[x] for x in strings]


#: Names that operators might use themselves.
CLASHES = ("_n", "_id", "_key", "_place", "_hashes", "hashes", "id", "fp", "rank", "embedding", "key", "copies", "rows", "place", "n", "row", "hash", "unnamed", "node", "h", "tie", "d", "spans", "size", "score", "text2")


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 3, "en", f"s{i % 2}", 9) for i in range(12)], SCHEMA)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("mine"))
    for kept in (simhash.keep_one_of_each(docs), mixing.mix_rows(docs)):
        assert kept.columns == docs.columns and {r[c] for r in kept.collect() for c in CLASHES} == {"mine"}
    got = repeats.remove_repeats(docs, keep=("id", "_id", "d", "tie", "spans", "_keep0")[:5]).collect()
    assert len(got) == 12 and {r["_id"] for r in got} == {"mine"}
    for frame, most in ((sketch.with_sketch(docs, "text", "s"), 12), (pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")), 12)):
        assert {r["_hashes"] for r in frame.collect()} == {"mine"} and frame.count() == most
    assert simhash.near_duplicates(docs).count() == 12
    assert quality.assess(docs).count() == 12
    assert langid.identify(docs).count() == 12
    assert toxicity.score_documents(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")).count() == 12
    assert sketch.edited_pairs(docs).count() == 12
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "vec_id bigint, embedding array<double>")
    for c in ("h", "one", "list", "segment", "block", "score", "rank", "ids", "q"):
        vectors = vectors.withColumn(c, F.lit("mine"))
    assert neighbours.nearest(vectors, F.col("vec_id") == 0).count() == 5


def test_repeats_odd_rows(spark, odd, none):
    got = repeats.remove_repeats(odd, keep=("lang", "source")).collect()
    assert len(got) == len(ODD)
    assert {r.kept_text for r in got if r.doc_id == 2} == {""}
    ids = spark.createDataFrame([(1, "q" * 50 + "abcdefghij" * 12), (1, "abcdefghij" * 12 + "z"), (1, "q" * 50 + "abcdefghij" * 12)], "doc_id bigint, text string")
    twice = repeats.remove_repeats(ids).collect()
    assert len(twice) == 3 and sum(r.n_removed > 0 for r in twice) >= 1
    assert repeats.remove_repeats(none).count() == 0


def test_whole_characters():
    text = "aé日b".encode()
    runs = np.array([[2, 5]])
    assert repeats.kept_bytes(text, repeats.whole_characters(text, runs)).decode() == "aé日b"
