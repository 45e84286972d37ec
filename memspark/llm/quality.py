"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Nine heuristics look at a whole text and vote good, bad or abstain; some overlap. How often each pattern of
votes occurs (at most 2^9 patterns, counted by Spark over all documents) is all that the EM needs
to estimate the share of bad texts and each labeller's votes on either class, and from these its
accuracy and a posterior for each pattern. A logistic scorer over hashed word shapes, repetition and the like is
then fitted to the posteriors on a sample of ``SAMPLE`` rows at most; it decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from memspark.session import materialize, ship_package

GOOD, BAD, ABSTAIN = "g", "b", "-"
DIMENSIONS = 1 << 12
SAMPLE = 6_000
_SHAPE = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_SYMBOLS = b"#&$%*|~^<>{}[]=+@\\"
#: Statistics that are features too, and their bins for one unit.
_SCALES = {"symbols": 20, "upper": 10, "top": 10, "again": 20, "bangs": 10, "bars": 10, "letters": 10, "kinds": 10, "length": 0.25, "lines": 10}
_AT: dict[bytes, int] = {}


def statistics(text: str | None) -> dict[str, float]:
    """What the labellers look at; an empty text has zero words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return {"words": 0.0}
    size = sum(map(len, words))
    shape = raw.translate(_SHAPE)
    upper, lower = shape.count(b"A"), shape.count(b"a")
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "words": float(n),
        "symbols": sum(raw.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS))) / size,
        "upper": upper / max(1, upper + lower),
        "letters": (upper + lower) / size,
        "top": max(count.values()) / n,
        "kinds": len(count) / n,
        "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "bangs": raw.count(b"!") / n,
        "bars": raw.count(b" | ") / n,
        "ends": (raw.count(b".") + raw.count(b"?") + raw.count(b"!") + raw.count("。".encode())) / n,
        "length": size / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "n_lines": float(len(lines)),
    }


def votes(s: dict[str, float]) -> str:
    """One letter for each labeller: eight look for a fault each, the last for ordinary prose."""
    if not s["words"]:
        return BAD + ABSTAIN * 8
    n = s["words"]
    faults = (
        s["symbols"] > 0.12 and n >= 8,
        (s["upper"] > 0.6 or s["bangs"] > 0.4) and n >= 8,
        s["top"] > 0.4 and n >= 10,
        n * s["again"] >= 6 and s["again"] > 0.1,
        s["bars"] > 0.15 and n >= 8,
        s["letters"] < 0.7 and n >= 20,
        s["length"] > 30 and n >= 8,
        s["lines"] > 0.4 and s["n_lines"] >= 5,
    )
    ordinary = s["symbols"] < 0.03 and s["upper"] < 0.25 and s["bangs"] < 0.05 and s["bars"] < 0.02 and s["again"] < 0.08 and (s["lines"] < 0.4 or s["n_lines"] < 5)
    return "".join(BAD if f else ABSTAIN for f in faults) + (GOOD if ordinary else ABSTAIN)


def features(text: str | None, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: places and weights."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count: Counter[bytes] = Counter(_RUN.sub(rb"\1", raw.translate(_SHAPE)).split())
    total = sum(count.values())
    values = {b"s:" + k[:24]: v / total for k, v in count.items()} if total else {b"none": 1.0}
    if s["words"] >= 8:  # a few words say little about a text's habits
        for name, scale in _SCALES.items():
            values[f"{name}:{min(10, int(s[name] * scale))}".encode()] = 0.5
    place = np.empty(len(values), dtype=np.int64)
    for i, k in enumerate(values):
        h = _AT.get(k)
        if h is None:
            if len(_AT) > 200_000:
                _AT.clear()
            _AT[k] = h = xxhash.xxh32_intdigest(k) % DIMENSIONS
        place[i] = h
    return place, np.sqrt(np.fromiter(values.values(), np.float64, len(values)))


class LabelModel:
    """How often each labeller gives each vote on either class, and the share of bad texts."""

    def __init__(self, patterns: list[str], counts: np.ndarray, rounds: int = 200) -> None:
        vote = np.array([[[c == v for v in (BAD, GOOD, ABSTAIN)] for c in p] for p in patterns], dtype=float)
        n = counts.astype(float)
        bad = np.where(vote[:, :, 0].any(1), 0.9, 0.02)  # a fault that one labeller sees counts at first
        for _ in range(rounds):
            self.share = float(np.clip((n * bad).sum() / n.sum(), 1e-4, 0.5))
            self.rates = []
            for w in (n * (1 - bad), n * bad):
                seen = np.einsum("p,pjv->jv", w, vote) + 0.1
                self.rates.append(seen / seen.sum(1, keepdims=True))
            odds = np.log(self.share / (1 - self.share)) + np.einsum("pjv,jv->p", vote, np.log(self.rates[1] / self.rates[0]))
            was, bad = bad, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(was - bad).max() < 1e-7:
                break
        self.posterior = dict(zip(patterns, bad.tolist(), strict=True))

    def accuracy(self) -> np.ndarray:
        """Of each labeller's votes, the share that is right."""
        right = self.share * self.rates[1][:, 0] + (1 - self.share) * self.rates[0][:, 1]
        wrong = self.share * self.rates[1][:, 1] + (1 - self.share) * self.rates[0][:, 0]
        return right / np.maximum(right + wrong, 1e-12)


def fit_scorer(row: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the constant) of P(bad) for sparse rows of features and soft labels."""
    n = len(y)
    w, velocity = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-3), 0.5 / max((y <= 0.5).mean(), 1e-3))
    for _ in range(rounds):
        z = np.bincount(row, weights=w[place] * value, minlength=n) + w[-1]
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.append(np.bincount(place, weights=value * r[row], minlength=DIMENSIONS), r.sum())
        velocity = 0.9 * velocity - rate * (slope + penalty * w)
        w += velocity
    return w


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[LabelModel, np.ndarray] | None:
    """The label model over all documents and the scorer's weights; None for an empty table."""

    @F.pandas_udf(T.StringType())
    def vote(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([votes(statistics(t)) for t in s], dtype="object")

    voted = materialize(docs.select(F.col(id_col).alias("id"), vote(F.col(text_col)).alias("votes")), "votes")
    counts = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()
    if not len(counts):
        return None
    model = LabelModel(counts["votes"].tolist(), counts["n"].to_numpy())
    bad = np.array([model.posterior[v] > 0.5 for v in counts["votes"]])
    rate = {}
    for side in (True, False):  # half of the sample from either side
        n = counts["n"].to_numpy()[bad == side].sum()
        rate |= dict.fromkeys(counts["votes"][bad == side], int(min(1.0, SAMPLE / 2 / max(n, 1)) * (1 << 30)))
    chance = F.create_map(*(F.lit(x) for kv in rate.items() for x in kv))
    ids = voted.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < chance[F.col("votes")]).select("id", "votes").dropDuplicates(["id"])

    @F.pandas_udf(T.StructType([T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]))
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = [features(t, statistics(t)) for t in s]
            yield pd.DataFrame({"place": [p.astype(np.int32) for p, _ in rows], "value": [v.astype(np.float32) for _, v in rows]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "id").select("id", "votes", hashed("t").alias("x")).select("id", "votes", "x.place", "x.value").orderBy("id", "votes").toPandas()
    if not len(rows):
        return model, np.zeros(DIMENSIONS + 1)
    sizes = rows["place"].map(len).to_numpy()
    weights = fit_scorer(np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows["place"].to_numpy()), np.concatenate(rows["value"].to_numpy()).astype(np.float64), rows["votes"].map(model.posterior).to_numpy())
    weights[-1] += np.log(model.share / (1 - model.share))  # the fit saw both classes as equally large
    return model, weights


def assess(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the columns ``quality_score`` (0 to 1, higher: better) and ``quality_ok``.

    Null and empty texts are bad. Rows that repeat are judged alike; all columns pass through, and
    columns of those two names are replaced.
    """
    ship_package(docs.sparkSession)
    fitted = fit(docs, text_col, id_col)
    weights = fitted[1] if fitted else np.zeros(DIMENSIONS + 1)

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                st = statistics(t)
                if not st["words"]:
                    out.append(0.0)
                    continue
                place, value = features(t, st)
                z = float((weights[place] * value).sum() + weights[-1])
                out.append(1 / (1 + np.exp(np.clip(z, -30, 30))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("quality_score", score(F.col(text_col))).withColumn("quality_ok", F.col("quality_score") >= 0.5)
