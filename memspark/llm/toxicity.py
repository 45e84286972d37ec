"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney models over the characters of words (order ``ORDER``, word ends
included), one of toxic and one of ordinary labelled texts. Orders up to ``SHARED`` use counts of
both classes together, so a rare expression backs off to what both share and tells little, while
parts of it that one class prefers still count. A text is compared twice: by the difference of the
two log-likelihoods of all its words over their length, and by the largest such difference of one of
its expressions (over its length plus ``PAD``), so that an insult in a long text isn't averaged away.
A logistic curve of both, fitted on training rows that the models haven't seen, gives the score.

The models are fitted on a sample of labelled rows, about ``MAX_ROWS`` of each class at most,
chosen by a hash of the id, and counted by Spark. All counts of the sample enter the models; what
reaches driver and tasks is bounded by the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memspark.session import materialize, ship_package

MAX_ROWS = 20_000
ORDER = 6
SHARED = 2
PAD = 6.0
DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 0
#: Training rows with this remainder fit the logistic curve, the others the counts.
CURVE_FOLD = 1
#: Expressions whose evidence a worker remembers; a full memory is emptied.
REMEMBERED = 400_000
_BITS = 10
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x01", "\x02"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall((text or "").lower())


def sequence_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-character sequence that ends at each character of each word, and where words begin.

    Characters are hashed to 10 bits, so a sequence is one 60-bit key; its low bits are its end.
    """
    lead = _START * (ORDER - 1)
    flat = lead + (_END + lead).join(words) + _END
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    small = np.where(code < 3, code, (code * np.uint64(2654435761) >> np.uint64(7)) % np.uint64((1 << _BITS) - 3) + np.uint64(3))
    keys = np.zeros(len(small) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        keys = keys << np.uint64(_BITS) | small[k : k + len(keys)]
    real = code[ORDER - 1 :] != 1
    ends = np.array([len(w) + 1 for w in words], dtype=np.int64)
    return keys[real], np.cumsum(ends) - ends


def fold_of(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> DataFrame:
    """Training rows (text, y, fold): about ``max_rows`` of each class at most, by a hash of the id.

    Only the sample's ids, some 2 * max_rows at most, are broadcast to the documents.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("toxic").alias("y")).withColumn("fold", fold_of("id", FOLDS)).where(F.col("fold") != HELD_OUT)
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30))
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (draw < int(min(1.0, max_rows / n) * (1 << 30))))
    sample = own.where(keep).groupBy("id", "fold").agg(F.max("y").alias("y"))
    return docs.select(F.col(id_col).alias("id"), F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(sample), "id").select("text", "y", "fold")


def _count_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character sequences by class, of one batch after the other."""
    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[y].update(words_of(text))
        keys, counts = [], []
        for words in seen:
            if not words:
                keys.append(np.empty(0, np.uint64))
                counts.append(np.empty(0, np.int64))
                continue
            k, _ = sequence_keys(list(words))
            n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 1 for w in words])
            k, at = np.unique(k, return_inverse=True)
            keys.append(k)
            counts.append(np.bincount(at, weights=n, minlength=len(k)).astype(np.int64))
        every = np.union1d(*keys)
        full = np.zeros((2, len(every)), dtype=np.int64)
        for y in (0, 1):
            full[y, np.searchsorted(every, keys[y])] = counts[y]
        yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(full[0]), pa.array(full[1])], names=["key", "n0", "n1"])


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the column sums of their rows of values."""
    k, at = np.unique(keys, return_inverse=True)
    return k, np.stack([np.bincount(at, weights=v, minlength=len(k)) for v in values.T], axis=1) if len(k) else np.zeros((0, values.shape[1]))


def _look(table: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.zeros((len(at), values.shape[1]))
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where((keys[i] == at)[:, None], values[i], 0)


class Model:
    """Both classes' interpolated Kneser-Ney models from counts of ORDER-character sequences."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT) -> None:
        self.d = discount
        self.grams: dict[int, tuple] = {}
        self.contexts: dict[int, tuple] = {}
        k, n = _sum_by(keys, counts.astype(np.float64))
        for order in range(ORDER, 0, -1):
            if order <= SHARED:
                n = np.repeat(n.sum(1, keepdims=True) if n.shape[1] == 2 and order == SHARED else n[:, :1], 2, axis=1)
            self.grams[order] = (k, n.astype(np.float32))
            self.contexts[order] = tuple(_sum_by(k >> np.uint64(_BITS), np.concatenate([n, n > 0], axis=1)))
            if order > 1:  # lower orders count the different characters that precede
                k, n = _sum_by(k & np.uint64((1 << _BITS * (order - 1)) - 1), (n > 0).astype(np.float64))
        self.known: dict[str, float] = {}

    def difference(self, keys: np.ndarray) -> np.ndarray:
        """log P(character | before, toxic) - log P(character | before, ordinary)."""
        p = np.full((len(keys), 2), 1.0 / (1 << _BITS))
        for order in range(1, ORDER + 1):
            end = keys & np.uint64((1 << _BITS * order) - 1)
            c, ctx = _look(self.grams[order], end), _look(self.contexts[order], end >> np.uint64(_BITS))
            n, kinds = ctx[:, :2], ctx[:, 2:]
            seen, safe = n > 0, np.maximum(n, 1)
            p = np.where(seen, np.maximum(c - self.d, 0) / safe, 0) + np.where(seen, self.d * kinds / safe, 1.0) * p
        logs = np.log(np.maximum(p, 1e-12))
        return logs[:, 1] - logs[:, 0]

    def learn(self, words: list[str]) -> None:
        """Remember the evidence of some expressions."""
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            keys, starts = sequence_keys(part)
            unique, at = np.unique(keys, return_inverse=True)
            total = np.add.reduceat(self.difference(unique)[at], starts)
            self.known.update(zip(part, total.tolist(), strict=True))

    def evidence(self, texts: list[str | None]) -> list[tuple[float, float]]:
        """Of each text the largest evidence of its expressions, and the evidence of all its words together; zeros without a letter."""
        split = [words_of(t) for t in texts]
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = every
        self.learn(sorted(new))
        return [self._compared(w) for w in split]

    def _compared(self, words: list[str]) -> tuple[float, float]:
        if not words:
            return 0.0, 0.0
        times = Counter(words)
        total = np.fromiter(map(self.known.__getitem__, times), np.float64, len(times))
        length = np.fromiter(map(len, times), np.float64, len(times)) + 1
        n = np.fromiter(times.values(), np.float64, len(times))
        return float((total / (length + PAD)).max()), float((total * n).sum() / (length * n).sum())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def fit_counts(sample: DataFrame) -> Model:
    """Count the sample's sequences in Spark and build the models from all of them."""
    grams = sample.select("text", "y").mapInArrow(_count_sequences, "key bigint, n0 bigint, n1 bigint").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = materialize(grams, "sequences").toPandas()
    return Model(got["key"].to_numpy(np.int64).view(np.uint64), got[["n0", "n1"]].to_numpy(np.int64))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights and offset for rows of evidence x and labels y; a plain curve of the first where one class lacks."""
    if len(x) < 10 or y.sum() < 3 or (1 - y).sum() < 3:
        return np.array([6.0, 0.0]), -7.2
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    at, penalty = np.array([1.0, 0.0, 0.0]), np.array([0.1, 0.1, 0.0])
    for _ in range(100):  # Newton steps with a light penalty
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        v = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (weight * (p - y)) + penalty * at)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    at[:2] = np.maximum(at[:2], [1e-3, 0.0])  # more evidence never lowers a score
    return at[:2] / scale, float(at[2] - (at[:2] * mean / scale).sum())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted, evidence, text_evidence) of every row.

    Null and empty texts and those without a letter have evidence 0. Without usable labels every
    text's evidence is 0. Rows that repeat are scored alike. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    sample = materialize(labelled_sample(docs.select(F.col(id_col), F.col(text_col).alias("text")), labels, max_rows, id_col), "sample")
    model = fit_counts(sample.where(F.col("fold") != CURVE_FOLD))

    @F.pandas_udf(T.StructType([T.StructField("evidence", T.DoubleType()), T.StructField("text_evidence", T.DoubleType())]))
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            found: list[tuple[float, float]] = []
            for i in range(0, len(s), 256):
                found += model.evidence(s.iloc[i : i + 256].tolist())
            yield pd.DataFrame(found, columns=["evidence", "text_evidence"], dtype="float64")

    curve = sample.where(F.col("fold") == CURVE_FOLD).select(evidence("text").alias("x"), "y").select("x.*", "y").toPandas()
    slopes, offset = fit_curve(curve[["evidence", "text_evidence"]].to_numpy(np.float64), curve["y"].to_numpy(np.float64))
    height = F.lit(float(slopes[0])) * F.col("evidence") + F.lit(float(slopes[1])) * F.col("text_evidence") + F.lit(offset)
    score = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -height))))
    out = docs.select(F.col(id_col), evidence(F.col(text_col)).alias("x")).select(id_col, "x.*").withColumn("score", score)
    return out.select(id_col, F.coalesce(fold_of(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "text_evidence")
