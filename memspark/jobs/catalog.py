"""The registered queries of the core library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from memspark.functions import classify, embed, text as tx
from memspark.operators import capture, index, relevance, search, telemetry
from memspark.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Words that occur in the test tables stand in for phrases, which don't.
CORRECTIONS, DECISIONS, INVESTIGATIONS = ["that", "est "], ["with", "und "], ["this", "les "]
BM25_QUERY = "the, tion with. ing that"
ROSTER = ["tion", "ing", "the", "und", "que"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _clip(t: str, n: int) -> str:
    """Collapsed text ``t`` clipped to ``n`` characters."""
    h = f"substring({t}, 1, {n - 1})"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(CASE WHEN substring({t}, {n}, 1) <> ' ' AND contains({h}, ' ') AND length({h}) - instr(reverse({h}), ' ') > 0 THEN substring({h}, 1, length({h}) - instr(reverse({h}), ' ')) ELSE {h} END) || '…' END"


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


_KEPT: dict[tuple[str, str], index.Index] = {}


def kept_index(spark: SparkSession, sf: str) -> index.Index:
    """The index of ``documents``: built by the first query that asks, in the shared folder, and kept for the application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        _KEPT[key] = index.build(_docs(spark, sf))
    return _KEPT[key]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: id, content, source, weight surrogate."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", (F.col("n_chars") % 100).cast("int").alias("signal_weight"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text")


TOK = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}\p{{Co}}\p{{M}}]+'), lambda t: t <> '')"
_BM25 = f"""
toks AS (SELECT doc_id AS id, {TOK.format(c='text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the','tion','with','ing','that']) AS term) GROUP BY term),
ex AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, greatest(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END, 1e-6) AS idf FROM df, st),
bm AS (SELECT id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score
       FROM tf JOIN w USING (term) JOIN q USING (term), st GROUP BY id)"""


@query(f"WITH {_BM25} SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm) WHERE rank < 10")
def d3_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame([(0, BM25_QUERY)], "query_id int, query string")
    return index.search(kept_index(spark, sf), q, 10)[0].select("id", "score", "rank")


@query(f"""WITH toks AS (SELECT doc_id AS id, {TOK.format(c='text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
pr AS (SELECT item_id AS query_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: trim(x, '.,!?;:()[]{{}}<>')), lambda x: x <> '') AS ws FROM benchmark),
qt AS (SELECT query_id, w, {TOK.format(c='w')} AS p FROM (SELECT query_id, unnest(ws) AS w FROM pr)),
q AS (SELECT query_id, p[1] AS term, count(*) AS times FROM qt WHERE len(p) = 1 GROUP BY query_id, p[1]),
ex AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
bm AS (SELECT query_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score FROM tf JOIN w USING (term) JOIN q USING (term), st GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM bm) WHERE rank < 5""")
def d3_bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search(kept_index(spark, sf), q, 5, 6)[0].select("query_id", "id", "score", "rank")


@query()
def d3_scored_postings(spark: SparkSession, sf: str) -> DataFrame:
    """How many postings each batch query's words have, and how many of them its search scored."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search(kept_index(spark, sf), q, 5)[1].select("query_id", "postings", "scored")


@query("SELECT item_id AS query_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: trim(x, '.,!?;:()[]{}<>')), lambda x: x <> '') AS terms FROM benchmark")
def d1_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), search.query_terms(F.col("text")).alias("terms"))


@query("""WITH t AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: trim(x, '.,!?;:()[]{}<>')), lambda x: x <> '') AS w FROM documents),
u AS (SELECT id, w, CASE WHEN len(w) > 256 THEN list_filter(w, lambda x: length(x) <= 64) ELSE w END AS f FROM t)
SELECT id, CASE WHEN len(w) > 256 THEN least(256, len(list_distinct(f))) ELSE len(w) END AS n_terms FROM u""")
def d2_query_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", F.size(search.query_terms(F.col("content"))).cast("bigint").alias("n_terms"))


_ECHO = r"(?i)^\s*(?:" + "|".join(tx.lexicon.STATUS_ECHO).replace("'", "''") + r")\s*[.!]*\s*$"
_VEC = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"


#: Queries of the searches: every vector whose id is divisible by 50, with the tokens of that document.
_ASKED = f"""e AS ({_VEC}),
toks AS (SELECT doc_id AS id, {TOK.format(c='text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
qw AS (SELECT id AS query_id, len(t) AS n, unnest(t) AS term, unnest(range(len(t))) AS nth FROM toks JOIN e ON vec_id = id WHERE id % 50 = 0),
q AS (SELECT query_id, term, times FROM (SELECT query_id, term, max(n) AS n, CASE WHEN max(n) > 256 THEN 1 ELSE count(*) END AS times, row_number() OVER (PARTITION BY query_id ORDER BY min(nth)) AS place FROM qw WHERE n <= 256 OR length(term) <= 64 GROUP BY query_id, term) WHERE n <= 256 OR place <= 256),
ex AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
bm AS (SELECT query_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score FROM tf JOIN w USING (term) JOIN q USING (term), st GROUP BY query_id, id),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id IN (SELECT doc_id FROM documents))"""


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, vectors and queries (query_id, query, vector) of the searches."""
    docs, e = _docs(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    own = docs.where("id % 50 = 0").select("id", F.array_join(search.tokens(F.col("content")), " ").alias("query"))
    q = e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return docs, e, q.join(own, q["query_id"] == own["id"]).select("query_id", "query", "vector")


@query(f"""WITH e AS ({_VEC}), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) - 1 AS rank FROM s) WHERE rank < 10""")
def d4_knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.knn(e.withColumnRenamed("vec_id", "chunk_id"), q, 10).select("query_id", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def _legs(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    docs, e, q = _asked(spark, sf)
    return search.bm25(docs, q, k), search.knn(e, q, k).withColumnRenamed("chunk_id", "id")


_FUSED = f"""{_ASKED},
a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS r FROM bm QUALIFY r < 30),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS r FROM d QUALIFY r < 30),
fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (61 + a.r), 0) + coalesce(1.0::DOUBLE / (61 + b.r), 0), 12) AS fusion_score FROM a FULL JOIN b ON a.id = b.id AND a.query_id = b.query_id)"""


@query(f"WITH {_FUSED} SELECT query_id, id, fusion_score FROM fu")
def d5_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuse(*_legs(spark, sf, 30)).select("query_id", "id", "fusion_score")


_VET = "coalesce(l.quality = 0, false) OR coalesce(l.toxic = 1, false) OR d.n_chars % 100 >= 50"
_FINAL = "round(fusion_score * (1 + CASE WHEN d.n_chars % 100 = 0 THEN 10 ELSE d.n_chars % 100 END / 100.0::DOUBLE), 12) AS final_score"


@query(f"""WITH {_FUSED}, r AS (SELECT query_id, fu.id, {_FINAL} FROM fu JOIN documents d ON d.doc_id = fu.id LEFT JOIN labels l ON l.doc_id = fu.id WHERE {_VET})
SELECT query_id, id, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) - 1 AS rank FROM r) WHERE rank < 10""")
def d7_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """A query's words are those of a whole document, and the queries grow with the table: the texts are scored in blocks, not looked up in the kept index."""
    docs, e, q = _asked(spark, sf)
    text = search.bm25(docs, q, 30)
    docs = docs.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    vetted = classify.vetted(F.lit(False), F.col("toxic") == 1, F.col("quality") == 0, F.col("signal_weight"))
    return search.hybrid(docs, e, q, 10, vetted, ("signal_weight", "toxic", "quality"), text=text).select("query_id", "id", "final_score", "rank")


@query(f"WITH {_FUSED} SELECT query_id, fu.id, {_FINAL} FROM fu JOIN documents d ON d.doc_id = fu.id")
def d6_boost(spark: SparkSession, sf: str) -> DataFrame:
    return search.boost(search.fuse(*_legs(spark, sf, 30)).join(_docs(spark, sf), "id")).select("query_id", "id", "final_score")


@query(f"""WITH {_FUSED}, r AS (SELECT query_id, fu.id, CASE WHEN fu.id % 3 = 0 THEN 'a mirror' ELSE d.source END AS origin_project, {_FINAL} FROM fu JOIN documents d ON d.doc_id = fu.id)
SELECT query_id, id, origin_project, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) - 1 AS rank FROM r) WHERE rank < 10""")
def d10_cross_project(spark: SparkSession, sf: str) -> DataFrame:
    """Each source is a project with chunks of its own; one more project mirrors every third chunk, and comes first."""
    docs, e, q = _asked(spark, sf)
    mirrored = docs.where("id % 3 = 0").withColumn("source", F.lit("a mirror"))
    return search.cross_project(docs.unionByName(mirrored).withColumnRenamed("source", "origin_project"), e, q).select("query_id", "id", "origin_project", "final_score", "rank")


@query(f"WITH {_ASKED}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS r FROM bm QUALIFY r < 30) SELECT query_id, id, round(1.0::DOUBLE / (61 + r), 12) AS fusion_score FROM a")
def d9_text_leg_only(spark: SparkSession, sf: str) -> DataFrame:
    """Queries whose embedding failed are answered by the text leg; each leaves a degradation row."""
    docs, e, q = _asked(spark, sf)
    asked, _ = search.without_vectors(q, q.select("query_id", F.lit("endpoint is down").alias("reason")), F.current_timestamp())
    near = search.knn(e, asked, 30).withColumnRenamed("chunk_id", "id")
    return search.fuse(search.bm25(docs, asked, 30), near).select("query_id", "id", "fusion_score")


class DeadEndpoint:
    """A provider whose endpoint doesn't answer."""

    dim, endpoint = 64, "http://127.0.0.1:9/embed"

    def embed(self, text: str) -> list[float]:
        raise ConnectionError("endpoint is down")


@query("SELECT 'search' AS component, vec_id AS query_id, 'ConnectionError: endpoint is down' AS detail FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0 AND vec_id % 100 = 0")
def d9_degradations(spark: SparkSession, sf: str) -> DataFrame:
    """Every second query is embedded anew by a dead endpoint, once for each worker; all of them lose their vector."""
    _, _, q = _asked(spark, sf)
    rows, _ = embed.guarded_embedding(q.where("query_id % 100 = 0").select("query_id", "query"), "query", DeadEndpoint())
    return search.without_vectors(q, rows.where("embed_error is not null").select("query_id", F.col("embed_error").alias("reason")), F.current_timestamp())[1].drop("ts")


@query(f"SELECT d.doc_id AS id, ({_VET}) AS vetted FROM documents d LEFT JOIN labels l USING (doc_id)")
def c13_vetted(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    return docs.select("id", classify.vetted(F.lit(False), F.col("toxic") == 1, F.col("quality") == 0, F.col("signal_weight")).alias("vetted"))


@query("SELECT id, doc_id FROM (SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS id, doc_id, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def c1_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return capture.first_by_content(table(spark, sf, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("id", "doc_id")


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def b2_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.collapse_ws(F.col("text"))).alias("collapsed"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT doc_id, t, substring(t, 1, 119) AS h FROM t)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(CASE WHEN substring(t, 120, 1) <> ' ' AND contains(h, ' ') AND length(h) - instr(reverse(h), ' ') > 0 THEN substring(h, 1, length(h) - instr(reverse(h), ' ')) ELSE h END) || '…' END AS clipped FROM h""")
def b3_clip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.clip(F.col("text"), 120).alias("clipped"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1)), chr(1))[1] AS first_sentence FROM t""")
def b4_first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("first_sentence"))


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'that') OR contains(lower(s), 'und ')) AS sentences FROM t""")
def b5_cue_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.sentences_with_cue(F.col("text"), ["that", "und "]).alias("sentences"))


_FORMS = [("the", "definite article"), ("und", "german and"), ("oft", "of the"), ("ing", "the tion")]


def _whole(c: str, token: str) -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9]){token}($|[^a-z0-9])')"


@query("WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), m AS (SELECT doc_id, [" + ", ".join(f"CASE WHEN {_whole('t', s)} THEN '{f}' END, CASE WHEN {_whole('t', f)} THEN '{s}' END" for s, f in _FORMS) + """] AS a FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x IS NOT NULL))), ' | ') AS aliases FROM m""")
def b6_aliases(spark: SparkSession, sf: str) -> DataFrame:
    forms = [(s, [f], []) for s, f in _FORMS]
    return table(spark, sf, "documents").select("doc_id", tx.derive_aliases(F.col("text"), forms).alias("aliases"))


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT doc_id, i, name, length(regexp_extract(t, '(?s)^(.*?(?:^|[^a-z0-9]))' || name || '(?:$|[^a-z0-9])', 1)) AS pos
FROM t, (VALUES (0, 'tion'), (1, 'ing'), (2, 'the'), (3, 'und'), (4, 'que')) r(i, name) WHERE regexp_matches(t, '(^|[^a-z0-9])' || name || '($|[^a-z0-9])'))
SELECT d.doc_id, x.name AS module FROM documents d LEFT JOIN (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS r FROM p) x ON x.doc_id = d.doc_id AND x.r = 1""")
def b7_module(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.detect_module(F.col("text"), ROSTER).alias("module"))


_STOP = "['" + "','".join(tx.lexicon.STOPWORDS) + "']"
_SHORT = "['" + "','".join(tx.lexicon.ALLOWED_SHORT) + "']"
_META = "['" + "','".join(tx.meta_tokens()) + "']"
_SIG = f"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({_STOP}, t) AND (length(t) >= 4 OR list_contains({_SHORT}, t)))"


@query(f"SELECT doc_id, list_sort(list_distinct({_SIG})) AS tokens FROM documents")
def b8_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_sort(tx.significant_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT item_id, list_sort(list_filter(list_distinct({_SIG}), lambda t: NOT list_contains({_META}, t))) AS tokens FROM benchmark")
def b9_prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_sort(tx.prompt_tokens(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, w.term, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}\\p{M}_])' || w.term || '($|[^\\p{L}\\p{N}\\p{M}_])') AS hit FROM documents, (VALUES ('the'), ('que'), ('und'), ('caf')) w(term)")
def b10_word_match(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(F.array(*(F.lit(w) for w in ("the", "que", "und", "caf")))).alias("term")
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"), words).select("doc_id", "term", tx.word_match(F.col("term"), F.col("t")).alias("hit"))


_TOPIC_WORDS = "regexp_extract_all(lower({c}), '([\\p{{L}}\\p{{N}}_]+)', 1)"
_TOPIC_STOP = "['" + "','".join(w.replace("'", "''") for w in tx.lexicon.TOPIC_STOPWORDS) + "']"


def _topic(c: str) -> str:
    words = _TOPIC_WORDS.format(c=c)
    symbols = [f"list_filter({words}, lambda w: regexp_full_match(w, '{p[2:-2]}'))[1]" for p in tx.lexicon.TOPIC_PATTERNS]
    return f"coalesce({', '.join(symbols)}, list_filter({words}, lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains({_TOPIC_STOP}, w))[1], '')"


@query(f"SELECT conv_id, turn, {_topic('text')} AS topic FROM conversations")
def b11_topic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.extract_topic(F.col("text")).alias("topic"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '([a-z]+=\"[a-z]+\")', 1))) AS symbols FROM pages")
def b12_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_sort(tx.extract_symbols(F.col("html"), ['([a-z]+="[a-z]+")'])).alias("symbols"))


@query("SELECT page_id, md5(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')) AS scrubbed FROM pages")
def b13_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(tx.scrub(F.col("html"))).alias("scrubbed"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-')[1:64] AS slug, sha256(c_custkey::VARCHAR || '|' || c_name)[1:16] AS short_id FROM customer")
def b14_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", tx.slug(F.col("c_name")).alias("slug"), tx.short_id(F.col("c_custkey").cast("string"), F.col("c_name")).alias("short_id"))


@query("""SELECT event_id, CASE WHEN floor(s / 86400) >= 1 THEN floor(s / 86400)::BIGINT ELSE 0 END AS days FROM (SELECT event_id, epoch(TIMESTAMP '2030-01-01 00:00:00') - floor(epoch(ts)) AS s FROM events)""")
def b18_age_days(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select("event_id", tx.age_days(iso, F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("days"))


@query(f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN {_any('text', CORRECTIONS)} THEN 100 WHEN {_any('text', DECISIONS)} THEN 50 WHEN {_any('text', INVESTIGATIONS)} THEN 30 ELSE 10 END
WHEN role = 'assistant' THEN CASE WHEN {_any('text', DECISIONS)} THEN 20 ELSE 0 END ELSE 20 END AS weight FROM conversations""")
def c3_signal_weight(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", classify.signal_weight(F.col("text"), F.col("role"), CORRECTIONS, DECISIONS, INVESTIGATIONS).alias("weight"))


@query(f"SELECT conv_id, turn, role = 'user' AND {_any('text', CORRECTIONS)} AS correction, {_any('text', DECISIONS)} AS decision, {_any('text', INVESTIGATIONS)} AS dnr FROM conversations")
def c5_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", classify.is_correction(t, F.col("role"), CORRECTIONS).alias("correction"), classify.is_decision(t, DECISIONS).alias("decision"), classify.is_do_not_rebuild(t, INVESTIGATIONS).alias("dnr"))


@query(f"SELECT item_id, {_any('text', CORRECTIONS)} AND NOT {_any('text', ['ing '])} AS build, {_any('text', INVESTIGATIONS)} AS investigate, {_any('text', DECISIONS)} AS decide FROM benchmark")
def c9_intents(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", classify.build_intent(t, CORRECTIONS, ["ing "]).alias("build"), classify.investigation_intent(t, INVESTIGATIONS).alias("investigate"), classify.decision_intent(t, DECISIONS).alias("decide"))


@query("""SELECT doc_id, CASE WHEN starts_with(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)), 'The ') THEN 'opener' WHEN contains(text, '###') THEN 'junk' WHEN contains(text, 'token = ') THEN 'secret' END AS reason FROM documents""")
def c2_harness_reason(spark: SparkSession, sf: str) -> DataFrame:
    markers = [("The ", "opener", "prefix"), ("###", "junk", "tag"), ("token = ", "secret", "tag")]
    return table(spark, sf, "documents").select("doc_id", classify.harness_reason(F.col("text"), markers).alias("reason"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(c, '(?i)^\\s*(?:the|it|of .{0,20})\\s*[.!]*\\s*$') THEN 'status_echo' WHEN length(c) < 40 THEN 'too_short' END AS reason FROM (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1)), chr(1))[1] AS c FROM documents)""")
def c16_precision_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", classify.gate_reason(tx.first_sentence(F.col("text")), 40, ["the", "it", "of .{0,20}"]).alias("reason"))


@query("SELECT page_id, CASE WHEN string_split(url, '/')[-1] IN ('1', 'page.html') THEN 50 ELSE 20 END AS weight, regexp_matches(lower(string_split(url, '/')[-1]), '^(p|a)') AS curated, contains(url, 'example') AS narrative FROM pages")
def c4_path_rules(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", classify.doc_signal_weight(u, ["1", "page.html"]).alias("weight"), classify.is_curated_correction(u, ["p", "a"]).alias("curated"), classify.is_narrative(F.lit("web"), u, [], ["example"]).alias("narrative"))


@query("SELECT page_id, list_filter(['<h1>', '<table', '<nav', 'script'], lambda t: contains(html, t)) AS present FROM pages")
def c23_present_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", classify.present_tokens(F.col("html"), ["<h1>", "<table", "<nav", "script"]).alias("present"))


_DF = f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TOK.format(c='text')})) AS term FROM documents) GROUP BY term"


@query(f"SELECT count(*) AS n_terms, sum(df)::BIGINT AS n_postings FROM ({_DF})")
def d2_index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Builds the kept index of the documents (again, if there is one): its terms and postings."""
    _KEPT.pop((spark.sparkContext.applicationId, sf), None)
    return index.document_frequency(kept_index(spark, sf)).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))


_EDITED = "CASE WHEN doc_id % 10 = 0 THEN 'edited zebraword ' || text[200:] ELSE text END"


@query(_DF.replace("lower(text)", f"lower({_EDITED})"))
def d2_index_update(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies after every tenth document was replaced, by a new generation of the index."""
    docs = _docs(spark, sf).where("id % 10 = 0").select("id", "content")
    fresh = docs.withColumn("content", F.concat(F.lit("edited zebraword "), F.expr("substring(content, 200)")))
    return index.document_frequency(index.update(index.build(_docs(spark, sf)), docs, fresh))


@query(_DF)
def e2_df(spark: SparkSession, sf: str) -> DataFrame:
    return index.document_frequency(kept_index(spark, sf))


@query(f"WITH d AS ({_DF}), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(greatest(ln((n + 1) / (df + 1)::DOUBLE), 0), 9) AS idf FROM d, n")
def e3_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"))
    return relevance.document_frequency(docs, "doc_id", "text").crossJoin(F.broadcast(n)).select("term", F.round(relevance.idf(F.col("n"), F.col("df")), 9).alias("idf"))


_IN_ORDER = f"list_filter({_SIG}, lambda t: NOT list_contains({_META}, t))"
_GATE = f"""WITH d AS ({_DF}), n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT item_id AS prompt_id, list_filter({_IN_ORDER}, lambda t, i: list_position({_IN_ORDER}, t) = i)[1:32] AS ts FROM benchmark),
pt AS (SELECT prompt_id, unnest(ts) AS term FROM p),
i AS (SELECT pt.prompt_id, pt.term, n, greatest(ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE), 0) AS idf FROM pt LEFT JOIN d USING (term), n),
w AS (SELECT conv_id * 1000 + turn AS item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'))) AS term FROM conversations),
m AS (SELECT prompt_id, item_id, term, idf, n FROM i JOIN w USING (term)),
g AS (SELECT prompt_id, item_id, count(*) AS n_matched, round(sum(idf), 9) AS idf_sum, round(max(idf), 9) AS max_idf, count(*) FILTER (WHERE idf >= 3) AS n_distinctive, max(n) AS n FROM m GROUP BY prompt_id, item_id),
k1 AS (SELECT *, n_matched >= 2 AND (n < 50 OR (idf_sum >= 7 AND max_idf >= 3)) AS passed FROM g)"""


def _gate_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    items = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.lower("text").alias("item_text"))
    wanted = prompts.select(F.explode(tx.prompt_tokens(F.col("prompt"))).alias("term"))
    return prompts, items, index.token_idf(kept_index(spark, sf), wanted)


@query(f"{_GATE} SELECT prompt_id, item_id, n_matched, round(idf_sum, 6) AS idf_sum, round(max_idf, 6) AS max_idf, passed FROM k1")
def k1_lineage_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = relevance.lineage_gate(*_gate_inputs(spark, sf))
    return gated.select("prompt_id", "item_id", "n_matched", F.round("idf_sum", 6).alias("idf_sum"), F.round("max_idf", 6).alias("max_idf"), "passed")


@query(f"{_GATE} SELECT prompt_id, item_id, n_matched, n_distinctive, CASE WHEN n < 50 THEN n_matched ELSE n_distinctive END >= 2 AS passed FROM g")
def k2_item_gate(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.item_gate(*_gate_inputs(spark, sf)).drop("matched")


@query(f"{_GATE} SELECT prompt_id, item_id, place, round(idf_sum, 6) AS idf_sum FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY idf_sum DESC, n_matched DESC, item_id) AS place FROM k1 WHERE passed) WHERE place <= 2")
def h7_thread_hits(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.thread_hits(relevance.lineage_gate(*_gate_inputs(spark, sf))).select("prompt_id", "item_id", "place", F.round("idf_sum", 6).alias("idf_sum"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def f3_missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return capture.missing_vectors(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings"), "doc_id", "vec_id")


@query("SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) AS n_vectors, round((SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS ratio")
def e11_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left")
    return d.agg(F.count("*").alias("n_chunks"), F.count("has").alias("n_vectors")).withColumn("ratio", F.round(F.col("n_vectors") / F.col("n_chunks"), 9))


@query(f"""SELECT session_id, pos, user_correction, assistant_message FROM (SELECT conv_id AS session_id, turn AS pos, text AS user_correction, role, lag(role) OVER w AS pr, lag(text) OVER w AS assistant_message FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND pr = 'assistant' AND {_any('user_correction', CORRECTIONS)}""")
def g2_corrections(spark: SparkSession, sf: str) -> DataFrame:
    return capture.correction_events(_messages(spark, sf), CORRECTIONS).drop("topic")


@query(f"""WITH s AS (SELECT conv_id AS session_id, turn AS pos, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM conversations),
x AS (SELECT session_id, pos, i AS s, ss[i] AS t FROM (SELECT session_id, pos, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
k AS (SELECT session_id, pos, s, t, 'decision' AS kind FROM x WHERE {_any('t', DECISIONS)} UNION ALL SELECT session_id, pos, s, t, 'dead_end' AS kind FROM x WHERE {_any('t', CORRECTIONS)}),
g AS (SELECT session_id, pos, s, kind, {_clip('t', 200)} AS t FROM k WHERE length({_clip('t', 200)}) >= 40 AND NOT regexp_matches({_clip('t', 200)}, '{_ECHO}')),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, t ORDER BY pos, s) AS r FROM g),
c AS (SELECT session_id, kind, t AS title, pos, row_number() OVER (PARTITION BY session_id, kind ORDER BY pos, s) AS place FROM f WHERE r = 1)
SELECT * FROM c WHERE place <= 25""")
def k9_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = capture.candidates(_messages(spark, sf), DECISIONS, CORRECTIONS)
    return found.select("session_id", "kind", "title", "pos", "place")


@query(f"""WITH s AS (SELECT unnest(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS t FROM conversations),
c AS (SELECT {_clip('t', 200)} AS c FROM s WHERE {_any('t', DECISIONS)}),
w AS (SELECT regexp_matches(c, '{_ECHO}') AS echo, length(c) < 40 AS short FROM c)
SELECT 0 AS harness, 0 AS maintenance, count(*) FILTER (WHERE echo) AS status_echo, count(*) FILTER (WHERE NOT echo AND short) AS too_short, count(*) FILTER (WHERE NOT echo AND NOT short) AS kept FROM w""")
def k9_scan_skips(spark: SparkSession, sf: str) -> DataFrame:
    return capture.scan_skips(_messages(spark, sf), DECISIONS)


@query(f"""SELECT session_id, pos, {_topic("text || ' ' || assistant_message")} AS topic FROM (SELECT conv_id AS session_id, turn AS pos, text, role, lag(role) OVER w AS pr, lag(text) OVER w AS assistant_message FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND pr = 'assistant' AND {_any('text', CORRECTIONS)}""")
def k10_topics(spark: SparkSession, sf: str) -> DataFrame:
    return capture.correction_events(_messages(spark, sf), CORRECTIONS).select("session_id", "pos", "topic")


@query("""SELECT count(*) AS invocations, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS slow, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def e4_weekly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return telemetry.weekly_summary(e.crossJoin(e.agg(F.max("ts").alias("now"))), F.col("now"), {"errors": F.col("event_type") == "error", "slow": F.col("value") > 50, "purchases": F.col("event_type") == "purchase"})


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n FROM events WHERE value <> 0 GROUP BY event_type) SELECT event_type, n, l[n // 2 + 1] AS p50, l[least(n - 1, floor(n * 0.95)::BIGINT) + 1] AS p95 FROM v""")
def e5_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.grouped_nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT topic, count(*) AS n, min(event_id) AS first_seen FROM (SELECT event_id, unnest([event_type, 'user-' || (user_id % 7)]) AS topic FROM events) GROUP BY topic ORDER BY n DESC, first_seen, topic LIMIT 10")
def e6_topics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("topics", F.to_json(F.array("event_type", F.concat(F.lit("user-"), (F.col("user_id") % 7).cast("string")))))
    return telemetry.top_topics(e, "topics", "event_id")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'error') AS n_error, bool_or(event_type = 'error') AS warn FROM events GROUP BY user_id")
def e7_status(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.status_histogram(table(spark, sf, "events"), "user_id", "event_type", ["click", "view", "error"], ["error"])


@query("SELECT user_id, arg_max(event_type <> 'error', event_id) AS last_ok, arg_max(ts, event_id) AS last_ts, max(ts) FILTER (WHERE event_type <> 'error') AS newest_success FROM events GROUP BY user_id")
def e9_heartbeat(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.latest_heartbeat(table(spark, sf, "events"), "user_id", F.col("event_type") != "error", "ts", "event_id")


@query("SELECT event_id, user_id, event_type, r AS delivery FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2")
def g3_damping(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.damped(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], 2).select("event_id", "user_id", "event_type", "delivery")


@query("""WITH f AS (SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 3 = 0 AND d.user_id = e.user_id AND d.event_type = e.event_type))
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM f) WHERE r = 1""")
def g4_first_novel(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return telemetry.first_novel(e, e.where("event_id % 3 = 0"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY event_id DESC, user_id LIMIT 2")
def g6_recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.recent_sessions(table(spark, sf, "events"), "user_id", "event_id")


@query("""WITH h AS (SELECT sha256(event_id || '=' || event_type) AS h FROM events), b AS (SELECT h[1:3] AS b, sha256(string_agg(h, '' ORDER BY h)) AS s, count(*) AS n FROM h GROUP BY h[1:3])
SELECT sha256(string_agg(s, '' ORDER BY b) || chr(10) || sum(n)) AS signature FROM b""")
def e13_signature(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.corpus_signature(table(spark, sf, "events"), "event_id", "event_type")


_STATE = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END"


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread_id"), F.col("o_orderdate").cast("string").alias("date"), state.alias("state"))


@query("""SELECT c_custkey AS thread_id, c_name AS name, count(o_orderkey) OVER (PARTITION BY c_custkey) AS n_outcomes, CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) END AS place, o_orderkey::VARCHAR AS title FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def f5_lineage(spark: SparkSession, sf: str) -> DataFrame:
    threads = table(spark, sf, "customer").select(F.col("c_custkey").alias("thread_id"), F.col("c_name").alias("name"))
    outcomes = _outcomes(spark, sf).withColumn("title", F.col("id").cast("string"))
    return capture.thread_lineage(threads, outcomes, "thread_id", ["date", "id"], "title").select("thread_id", "name", "n_outcomes", "place", "title")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def f6_thread_exists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"SELECT state, count(*) AS n FROM (SELECT {_STATE} AS state FROM orders) GROUP BY state")
def e10_pending_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@query(f"SELECT id, thread_id, date FROM (SELECT o_orderkey AS id, o_custkey AS thread_id, o_orderdate::DATE::VARCHAR AS date, {_STATE} AS state FROM orders) WHERE state = 'confirmed' ORDER BY date DESC, id LIMIT 20")
def h4_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).where("state = 'confirmed'").withColumn("date", F.substring("date", 1, 10)).orderBy(F.desc("date"), "id").limit(20).select("id", "thread_id", "date")


@query("""WITH l AS (SELECT o_custkey AS thread_id, max(o_orderdate)::DATE::VARCHAR AS updated, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F')::DATE::VARCHAR AS k FROM orders GROUP BY o_custkey) SELECT thread_id, updated, k AS cache_key FROM l WHERE coalesce(k, '') <> coalesce(updated, '')""")
def k15_stale_cache(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf).withColumn("date", F.substring("date", 1, 10))
    threads = o.groupBy("thread_id").agg(F.max("date").alias("updated"), F.max(F.when(F.col("state") == "confirmed", F.col("date"))).alias("cache_key"))
    return capture.stale_lineage(threads, "cache_key", "updated").select("thread_id", "updated", "cache_key")


@query("""WITH t AS (SELECT unnest(['tion_', 'und', 'que']) AS topic), b AS (SELECT doc_id, count(*) AS n FROM documents, t WHERE lower(text) LIKE '%' || lower(topic) || '%' GROUP BY doc_id)
SELECT d.doc_id AS id, coalesce(n, 0) AS n_boosts, CASE WHEN n > 0 THEN least(100, n_chars % 100 + 20 * n) ELSE n_chars % 100 END AS boosted FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def j5_topic_boost(spark: SparkSession, sf: str) -> DataFrame:
    topics = spark.createDataFrame([("tion_",), ("und",), ("que",)], "topic string")
    return capture.topic_boost(_docs(spark, sf), topics, "content", "signal_weight").select("id", "n_boosts", "boosted")


@query("SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def j2_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return capture.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "ts", "event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def j3_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return capture.insert_or_ignore(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, count(*) AS delivery_count, max(ts) AS last_delivered FROM events GROUP BY user_id, event_type")
def j4_counters(spark: SparkSession, sf: str) -> DataFrame:
    return capture.counters(table(spark, sf, "events"), ["user_id", "event_type"], "ts")


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'decision' WHEN o_orderkey % 3 = 0 THEN 'dead_end' END AS kind, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'confirmed' WHEN 'F' THEN 'rejected' ELSE 'pending' END END AS state, o_custkey % 5 = 0 AS new_thread FROM orders""")
def j7_triage(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    verdict = F.when(F.col("o_orderstatus") == "O", "confirm").when(F.col("o_orderstatus") == "F", "reject").otherwise("attach")
    thread = F.concat(F.when(F.col("o_custkey") % 5 == 0, "new:Thread ").otherwise("thread-"), F.col("o_custkey").cast("string"))
    verdicts = o.select(F.col("o_orderkey").alias("id"), verdict.alias("verdict"), thread.alias("thread"))
    ids = o.select(F.col("o_orderkey").alias("id"))
    return capture.triage(verdicts, ids.where("id % 2 = 0"), ids.where("id % 3 = 0")).select("id", "kind", "state", "new_thread")


@query("""SELECT d.doc_id AS id, contains(text, '###') AS demoted, coalesce(toxic = 1, false) AND source <> 'src0' AS cleared, CASE WHEN contains(text, '###') THEN 0 ELSE n_chars % 100 END AS signal_weight FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j8_regrade(spark: SparkSession, sf: str) -> DataFrame:
    from memspark.functions import lexicon

    docs = _docs(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    chunks = docs.select("id", F.regexp_replace("content", "###", lexicon.HARNESS_MARKERS[1][0]).alias("content"), F.when(F.col("source") == "src0", "user").otherwise("assistant").alias("role"), (F.col("toxic") == 1).alias("is_correction"), (F.col("quality") == 0).alias("is_decision"), "signal_weight", F.lit(None).cast("string").alias("module"))
    return capture.regrade(chunks, tx.detect_module(F.col("content"), ROSTER), F.lit("docs")).select("id", "demoted", "cleared", "signal_weight")


@query("SELECT c_custkey AS id FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END ASC NULLS FIRST, c_custkey DESC LIMIT 10")
def h3_rotation(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("last_accessed"), F.col("c_custkey").alias("ingested_at"))
    return capture.rotation(c, F.lit(True), 10).select("id")


@query("SELECT o_orderkey AS id, datediff('day', o_orderdate::DATE, DATE '2000-01-01') AS age_days FROM orders WHERE o_orderstatus = 'F' AND datediff('day', o_orderdate::DATE, DATE '2000-01-01') >= 30 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def h6_prune(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingested_at"), (F.col("o_orderstatus") != "F").cast("int").alias("access_count"))
    return capture.prune_candidates(o, F.lit("2000-01-01 00:00:00").cast("timestamp")).select("id", "age_days")
