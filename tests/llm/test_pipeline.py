"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from memspark.llm import simhash
from memspark.llm.registry import tokenizer_path
from memspark.session import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF), name)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeated_passages", "mixing", "encoding"]
    for n in ("quality", "near_dedup", "repeated_passages", "mixing"):
        assert stages[n].columns == stages["documents"].columns


def test_quality_keeps_clean_documents(spark, stages):
    kept = rows(stages["quality"])
    clean = [r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)


def test_near_copies_go(stages):
    before = {d: set(simhash.shingle_hashes(r.text, 5).tolist()) for d, r in rows(stages["quality"]).items()}
    kept = set(rows(stages["near_dedup"]))
    linked = {(a, b) for a in before for b in before if a < b and len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])}
    root = {d: d for d in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {d for d in before if find(d) == d}
    assert kept == want


def test_no_passage_is_left_twice(stages):
    seen = Counter()
    for r in rows(stages["repeated_passages"]).values():
        b = r.text.encode()
        seen.update(b[p : p + 110] for p in range(len(b) - 109))  # 100, and room for whole characters
    # What is left may join to new strings where a run was cut out; input strings don't repeat.
    source = {d: r.text.encode() for d, r in rows(stages["near_dedup"]).items()}
    again = [s for s, n in seen.items() if n > 1]
    assert not [s for s in again if sum(s in t for t in source.values()) > 1]
    assert all(r.n_chars == len(r.text) for r in rows(stages["repeated_passages"]).values())


def test_mixing_takes_at_most_two_of_each(stages):
    taken = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(taken) <= set(rows(stages["repeated_passages"])) and max(taken.values()) <= 2


def test_encoding_equals_the_library(stages):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    got = stages["encoding"].collect()
    assert len(got) == stages["mixing"].count()
    assert all(r.ids == lib.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], table(spark, SF, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_arithmetic_of_sketches_and_mixing_against_sql(spark):
    """What SQL can say of the two queries: sizes, edited texts, sources' totals and targets."""
    import duckdb

    from memspark import llm
    from memspark.llm.mixing import targets

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS n FROM documents)
        SELECT doc_id, length(t), sha256(substring(t, 1, length(t) - length(t) // 4) || substring(n, 1, length(t) // 4)) FROM d""").fetchall()
    got = llm.queries()["op5_bottom_k_sketch"](spark, SF).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    sizes = dict(con.sql(r"SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT FROM documents GROUP BY source").fetchall())
    wanted = targets(sizes)
    for r in llm.queries()["op7_subset_sum_mixing"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "source"), "doc_id").collect():
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
