"""Embedding through a pluggable provider: any object with ``dim`` and ``embed(text)``."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from memspark.session import materialize, ship_package

#: A text that a provider can't take is cut to its head: first to this many characters, then by halves.
HEAD_CHARS, LEAST_CHARS = 24_000, 1_000


class TooLong(ValueError):
    """A provider's answer to a text beyond its window."""


class Embedder(Protocol):
    dim: int

    def embed(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Deterministic unit vectors of hashed words, for tests and as a fallback."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % self.dim] += 1.0 if h[4] & 1 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


#: Texts in one call to a provider that takes several.
EMBED_BATCH = 64


def embed_one(provider: Embedder, text: str) -> list[float]:
    """One text's vector, its head if it is too long; another width than promised is an error."""
    size = len(text)
    while True:
        try:
            v = provider.embed(text[:size])
            break
        except TooLong:
            if size <= LEAST_CHARS:
                raise
            size = HEAD_CHARS if size > HEAD_CHARS else max(LEAST_CHARS, size // 2)
    if len(v) != provider.dim:
        raise ValueError(f"expected {provider.dim} components, got {len(v)}")
    return v


def with_embedding(rows: DataFrame, text: str, provider: Embedder) -> DataFrame:
    """Rows with ``embedding`` (null on failure) and ``embed_error`` (null on success), in the place of such columns."""
    ship_package(rows.sparkSession)

    def one(t: str) -> tuple[list[float] | None, str | None]:
        try:
            return embed_one(provider, t), None
        except Exception as e:  # a row's failure is data, not the job's
            return None, f"{type(e).__name__}: {e}"[:500]

    def many(part: list[str]) -> list[tuple[list[float] | None, str | None]]:
        """One call for the batch where the provider has ``embed_batch``; if it fails, a call for each text."""
        call = getattr(provider, "embed_batch", None)
        if call is not None:
            try:
                found = call(part)
                if len(found) == len(part) and all(len(v) == provider.dim for v in found):
                    return [(list(v), None) for v in found]
            except Exception:  # noqa: S110  told row by row below
                pass
        return [one(t) for t in part]

    @F.pandas_udf(T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            own = [t or "" for t in s]
            out = [x for i in range(0, len(own), EMBED_BATCH) for x in many(own[i : i + EMBED_BATCH])]
            yield pd.DataFrame(out, columns=["embedding", "embed_error"])

    kept = [c for c in rows.columns if c not in ("embedding", "embed_error")]
    return rows.withColumn("_e", run(F.col(text))).select(*kept, "_e.embedding", "_e.embed_error")


class Circuit:
    """Whether a worker still asks an endpoint: closed, open after a failure, half open once ``retry_s`` seconds have passed.

    Half open, one call is let through: its success closes the circuit, its failure opens it again.
    """

    def __init__(self, retry_s: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.retry_s, self.clock = retry_s, clock
        self.opened: float | None = None
        self.reason = ""

    @property
    def state(self) -> str:
        return "closed" if self.opened is None else "half open" if self.clock() - self.opened >= self.retry_s else "open"

    def call(self, ask: Callable[[], list[float]]) -> tuple[list[float] | None, str | None, bool]:
        """(answer, why there is none, whether this failure opened the circuit)."""
        was = self.state
        if was == "open":
            return None, self.reason, False
        try:
            answer = ask()
        except TooLong as e:  # the text's fault, not the endpoint's
            return None, f"TooLong: {e}"[:500], False
        except Exception as e:
            self.opened, self.reason = self.clock(), f"{type(e).__name__}: {e}"[:500]
            return None, self.reason, was == "closed"
        self.opened = None
        return answer, None, False


_CIRCUITS: dict[str, Circuit] = {}


def guarded_embedding(rows: DataFrame, text: str, provider: Embedder, retry_s: float = 60.0, component: str = "search") -> tuple[DataFrame, DataFrame]:
    """(rows, degradations): rows with ``embedding`` and ``embed_error`` as :func:`with_embedding`, through a circuit for each worker and endpoint.

    The first failure opens the worker's circuit: the rows after it have a null vector and that
    failure's reason without another call, so a dead endpoint costs each worker one timeout. Degradations
    (component, endpoint, reason): one row for each opening. Rows are written once, so that calls
    aren't repeated.
    """
    ship_package(rows.sparkSession)
    endpoint = str(getattr(provider, "endpoint", "") or type(provider).__name__)

    @F.pandas_udf("embedding array<float>, embed_error string, opened boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        circuit = _CIRCUITS.setdefault(endpoint, Circuit(retry_s))
        for s in texts:
            yield pd.DataFrame([circuit.call(lambda t=t: embed_one(provider, t or "")) for t in s], columns=["embedding", "embed_error", "opened"])

    kept = [c for c in rows.columns if c not in ("embedding", "embed_error", "opened")]
    done = materialize(rows.withColumn("_e", run(F.col(text))).select(*kept, "_e.*"), "embedded")
    return done.drop("opened"), done.where("opened").select(F.lit(component).alias("component"), F.lit(endpoint).alias("endpoint"), F.col("embed_error").alias("reason"))


def backfill(chunks: DataFrame, vectors: DataFrame, text: str, provider: Embedder) -> DataFrame:
    """Vectors of chunks (id, text) that have none yet: a hashed anti-join, then the provider."""
    missing = chunks.join(vectors.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
    return with_embedding(missing.select("id", text), text, provider).drop(text)


def backfill_summary(chunks: DataFrame, filled: DataFrame) -> DataFrame:
    """(total, embedded, failed, skipped)."""
    done = filled.agg(F.count("embedding").alias("embedded"), F.count("embed_error").alias("failed"))
    return chunks.agg(F.count("*").alias("total")).crossJoin(done).withColumn("skipped", F.col("total") - F.col("embedded") - F.col("failed"))
