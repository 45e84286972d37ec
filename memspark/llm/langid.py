"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (2 and 3 bytes of the lower-cased letters, blanks
between words), weighted by log term frequency and inverse document frequency and normalised.
Each language has several centroids, found by spherical k-means, and a text gets the language of
the centroid with the largest cosine. A text further from its centroid than nearly all training
texts of that centroid is marked as rejected; its best language stays in ``lang_pred``, because
``und`` is kept for texts without a letter, and its score is halved.

Document frequencies are counted over all training documents. Centroids are fitted on a sample
(``MAX_ROWS`` of each language at most, about), in one task for each language. The model holds
CENTROIDS vectors for each language that is tagged, of which there are a few thousand in the world.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memspark.session import materialize, ship_package

DIMENSIONS = 4096
CENTROIDS = 4
MAX_ROWS = 1_000
FOLDS, HELD_OUT = 4, 2
#: The share of a centroid's training texts that lie within its distance.
WITHIN = 0.995
SEED = 42
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are not letters become blanks.
_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; numerals such as fractions aren't."""
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 2- and 3-byte n-grams of a whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()) + b" "
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    for i in range(0, len(raw), _CHUNK):
        b = np.frombuffer(raw[i : i + _CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        two = (b[:-1] << 8 | b[1:])[: _CHUNK]
        three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) | np.uint32(1 << 24)
        for grams in (two, three):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF vectors of rows of counts."""
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for b in batches:
        for text in b.column(0).to_pylist():
            df += ngram_counts(text) > 0
            n += 1
    if n:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["at", "n"])


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def kmeans(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: centroids, and the row's centroid; farthest-first start."""
    rng = np.random.default_rng(seed)
    start = [int(rng.integers(len(x)))]
    best = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(best.argmin()))
        best = np.maximum(best, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


class Model:
    """Centroids of all languages, the cosine below which each rejects, and the idf."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, floors: np.ndarray) -> None:
        self.idf, self.languages, self.centroids, self.floors = idf, languages, centroids, floors

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if not at or not self.languages:
            return out
        cos = unit(np.stack([ngram_counts(texts[i]) for i in at]), self.idf) @ self.centroids.T
        for i, row, j in zip(at, cos, cos.argmax(1), strict=True):
            score, far = float(min(1.0, max(0.0, row[j]))), bool(row[j] < self.floors[j])
            out[i] = (self.languages[j], score / 2 if far else score, far)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_ROWS, centroids: int = CENTROIDS) -> Model:
    """Fit on rows (id, text, lang) of training documents; texts without a letter teach nothing."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = materialize(train.select("text").mapInArrow(_document_frequencies, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")), "frequencies").toPandas()
    n = int(rows.loc[rows["at"] == -1, "n"].sum())
    df = np.zeros(DIMENSIONS)
    seen = rows[rows["at"] >= 0]
    df[seen["at"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(idf, [], np.zeros((0, DIMENSIONS)), np.zeros(0))
    rate = F.create_map(*(x for lang, m in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, max_rows / m) * (1 << 30))))))
    sample = train.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < F.try_element_at(rate, F.col("lang")))

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(part["text"])
        x = unit(np.stack([ngram_counts(t) for t in texts]), idf)
        c, own = kmeans(x, centroids)
        near = (x * c[own]).sum(1)
        floors = [float(np.quantile(near[own == j], 1 - WITHIN)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "floor": floors})

    found = sample.select("text", "lang").groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, floor double").toPandas().sort_values(["lang", "centroid"])
    return Model(idf, found["lang"].tolist(), np.stack([np.frombuffer(b, np.float32) for b in found["centroid"]]), found["floor"].to_numpy())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) of every row, learnt from the training rows.

    Null texts and texts without a letter (empty ones too) are ``und`` with score 0; so is every
    row if nothing can be learnt. Rows that repeat get the same result; others columns aren't read.
    """
    ship_package(docs.sparkSession)
    own = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(own.where(fold_of(id_col) != HELD_OUT), id_col)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            found = []
            for i in range(0, len(s), 256):
                found += model.predict(s.iloc[i : i + 256].tolist())
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    return own.select(F.col(id_col), predict("text").alias("p")).select(id_col, F.coalesce(fold_of(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")
