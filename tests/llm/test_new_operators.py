"""Operators 11 to 13 against brute force, and on nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import alignment, byte_words, packing, variants
from memspark.llm.registry import tokenizer_path
from memspark.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
ODD = [
    (1, "alpha beta gamma, delta's 12 x1 <|endoftext|> end"), (1, "alpha beta gamma, delta's 12 x1 <|endoftext|> end"), (2, None), (3, ""), (4, "  \n\t "), (None, "null id  with two blanks\n\nand lines\n here"),
    (5, "naïve Ünïcode 日本語 テスト ▁ mark"), (6, "word " * 3_000), (6, " leading and trailing "), (None, "<0x41> <s> </s> \x00 \x01"), (7, "x" * 3_000), (8, "日本語テスト" * 300),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("n", F.lit("clash")).withColumn("pair", F.lit(1)).withColumn("length", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


# Encoding


@pytest.mark.parametrize("plain", [False, True])
def test_words_have_the_librarys_ids(texts, plain):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = plain
    own = byte_words.ByteCoder(tokenizer_path("byte_bpe_50k.json"), plain)
    rnd = random.Random(1)
    parts = ["a", "Bé", " ", "  ", "\n", "\t", "'s", "'ll", "12", "...", "(", " ", " ", "日本", "<|endoftext|>", "x9", "\r\n", "ŷ", "×", "¼", "\x1c", "́"]
    wild = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(2_000)]
    every = [t for _, t in texts] + [t or "" for _, t in ODD] + wild
    assert [x.tolist() for x in own.encode(every)] == [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert own.merger is not None


def test_words_without_ranks_go_through_the_library(texts):
    own, slow = byte_words.ByteCoder(tokenizer_path("byte_bpe_50k.json")), byte_words.ByteCoder(tokenizer_path("byte_bpe_50k.json"))
    slow.merger = None
    some = [t for _, t in texts[:20]]
    assert [x.tolist() for x in own.encode(some)] == [x.tolist() for x in slow.encode(some)]


def test_a_full_memory_of_words_is_emptied(texts, monkeypatch):
    want = [x.tolist() for x in byte_words.ByteCoder(tokenizer_path("byte_bpe_50k.json")).encode([t for _, t in texts])]
    monkeypatch.setattr(byte_words, "REMEMBERED", 50)
    assert [x.tolist() for x in byte_words.ByteCoder(tokenizer_path("byte_bpe_50k.json")).encode([t for _, t in texts])] == want


# 11 Alignment


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    known = byte_words.byte_of_char()
    docs, count = [], Counter()
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ba = [bytes(known[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
        owner_a, owner_b = np.repeat(np.arange(len(ia)), [len(x) for x in ba]), np.repeat(np.arange(len(ib)), [len(x) for x in bb])
        links = [(ia[x], ib[y]) for x, y in sorted(set(zip(owner_a.tolist(), owner_b.tolist(), strict=True)))]
        shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        sides = []
        for ids, ends in ((ia, ends_a), (ib, ends_b)):
            held = defaultdict(list)
            for i, g in zip(ids, np.searchsorted(shared, ends).tolist(), strict=True):
                held[g].append(str(i))
            sides.append([",".join(held[g]) for g in range(len(shared))])
        groups = list(zip(*sides, strict=True))
        count.update(links)
        docs.append((doc, ia, ib, groups, links))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc, ia, ib, groups, links in docs:
        digest = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if ia else ""
        out.append((doc, len(ia), len(ib), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str), count, Counter(p for *_, links in docs for p in set(links))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def by_operator(df):
    got = alignment.align_documents(df, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)


def test_alignment_matches_brute_force(spark, texts):
    some = [(d, t[:4_000]) for d, t in texts]
    df = spark.createDataFrame(some, SCHEMA).repartition(3)
    want, count, documents = aligned_by_hand(some)
    assert by_operator(df) == want
    rows = alignment.aligned(df, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    got = {(r.pair >> 16, r.pair & 65535): (r.n_docs, r["count"]) for r in alignment.pair_scores(rows).collect()}
    assert got == {p: (documents[p], count[p]) for p in count}


def test_alignment_of_odd_rows(odd):
    assert by_operator(odd) == aligned_by_hand(ODD)[0]


def test_alignment_of_an_empty_table(none):
    assert by_operator(none) == []


def test_bitmaps_hold_every_multiplicity():
    rnd = np.random.default_rng(5)
    block = alignment.Block(0)
    block.n = 900
    want = Counter()
    for pair, chance in ((3, 0.9), (1 << 31, 0.02), (70_000, 0.3)):
        for place in np.flatnonzero(rnd.random(900) < chance).tolist():
            want[pair, place] = int(rnd.integers(1, 9)) if rnd.random() < 0.9 else int(rnd.integers(1, 3_000_000_00))
    most = (1 << 22) - 1
    keys = []
    for (pair, place), n in want.items():
        keys += [pair << 32 | place << 22 | x for x in [most] * (n // most) + [n % most] * bool(n % most)]
    half = len(keys) // 2
    block.parts = [np.sort(np.array(k, dtype=np.uint64)) for k in (keys[:half], keys[half:])]
    got, popcounts = Counter(), 0
    for pair, plane, n, cuts, raw in block.rows():
        owner, place = alignment.places_of(-(-900 // 8), np.diff(cuts), raw)
        assert np.bincount(owner, minlength=len(pair)).tolist() == n.tolist()
        for p, at in zip(pair[owner].tolist(), place.tolist(), strict=True):
            got[p, at] += 1 if plane == 0 else 1 << plane - 1
    assert got == want


# 12 Variants


def grouped_by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    gaps = defaultdict(set)
    for w in words:
        gaps[w].add(w)
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :]].add(w)
            gaps[i, w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for key, group in gaps.items():
        for w in group:
            if isinstance(key, tuple):
                near[w] |= group - {w}
            elif key in words and key != w:
                near[w].add(key)
                near[key].add(w)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = set()
    for w, k in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, k, len(near[w]), words[form[w]] if w in form else None))
    return out


def variants_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(df).collect()}


def test_variants_match_brute_force(spark, texts):
    want = grouped_by_hand(texts)
    assert len(want) > 100
    assert any(w[4] for w in want)
    assert variants_of(table(spark, SF, "documents")) == want


def made_words():
    rnd = random.Random(3)
    rows, doc = [], 0
    for size in (6, 7, 9, 12, 47, 48, 49, 50, 200):
        base = "".join(rnd.choice("abcé") for _ in range(size))
        others = {base}
        for _ in range(25):
            w = rnd.choice(sorted(others))
            i, how = rnd.randrange(len(w)), rnd.randrange(3)
            others.add(w[:i] + rnd.choice("abcdÿ") + w[i + how // 2 :] if how else w[:i] + w[i + 1 :])
        for k, w in enumerate(sorted(others)):
            rows.append((doc, f"{w.upper() if w.isascii() else w} " * (5 if k % 3 else 5 * 5 ** (k % 4))))
            doc += 1
    return rows


def test_variants_of_made_words(spark):
    rows = made_words()
    want = grouped_by_hand(rows)
    assert any(r[2] != r[1] and r[1] for r in want)
    assert variants_of(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_levels_and_gapped_hashes_agree(spark):
    rows = made_words()
    words = variants.word_counts(spark.createDataFrame(rows, SCHEMA))
    pairs = [{tuple(r) for r in variants.near_words(words, long=k).collect()} for k in (6, 20, 300)]
    assert pairs[0] == pairs[1] == pairs[2]


def test_no_join_of_variants_is_broadcast(spark):
    """However small its sides seem: with Spark's default threshold many broadcasts at once filled a driver."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0b")
    words = variants.word_counts(spark.createDataFrame(made_words(), SCHEMA))
    for df in (variants.near_words(words), variants.variant_forms(words)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_variants_of_odd_rows(spark, odd, none):
    assert variants_of(odd) == grouped_by_hand(ODD)
    assert variants_of(none) == set()
    rows = [(None, "wörter wörter woerter"), (3, None), (3, ""), (3, "wörter " * 5 + "worter " * 30 + "x" * 5_000), *[(9, "same words wording wordin")] * 7]
    assert variants_of(spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit(1)).withColumn("run", F.lit(1))) == grouped_by_hand(rows)


# 13 Packing


def encoded(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def check_packing(got, rows, capacity=1024):
    by_doc = defaultdict(Counter)
    places = defaultdict(list)
    for r in got:
        by_doc[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for d, ids in encoded(rows):
        bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[d][k, x, y - x, zlib.crc32(np.array(ids[x:y], dtype="<u4").tobytes())] += 1
    assert by_doc == want
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def fit_by_hand(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing_matches_brute_force(spark, texts):
    got = packing.pack_documents(table(spark, SF, "documents"), tokenizer_path("byte_bpe_50k.json")).collect()
    assert check_packing(got, texts) == fit_by_hand([r.length for r in got], 1024)


def test_packing_of_odd_rows(odd, none):
    check_packing(packing.pack_documents(odd, tokenizer_path("byte_bpe_50k.json")).collect(), ODD)
    assert packing.pack_documents(none, tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("kind", ["even", "short", "one", "long"])
def test_packing_opens_as_few_sequences_as_best_fit(spark, kind):
    rnd = random.Random(kind)
    lengths = {"even": [rnd.randint(1, 64) for _ in range(800)], "short": [rnd.choice([1, 2, 3, 3, 3, 3, 20]) for _ in range(900)], "one": [7] * 700, "long": [rnd.randint(30, 64) for _ in range(500)]}[kind]
    df = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(lengths)], "item bigint, length bigint, sequence_id string")
    got = packing.pack(df, capacity=64).collect()
    assert sorted((r.item, r.length) for r in got) == list(enumerate(lengths))
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for held in rooms.values():
        assert [x for x, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 64
    assert len(rooms) == fit_by_hand(lengths, 64)
