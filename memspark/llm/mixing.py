"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words. A source's documents are counted by exact length; whole
passes over the source and an even share of each length fill most of the target, and a bounded
knapsack over the lengths left fills the remaining budget. Which documents of a length are taken
follows a seeded hash, so reruns agree.

The histogram is aggregated before it is shuffled; documents of one length in one source, however
many, are ranked in 256 slices whose offsets come from counts.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from memspark.llm.names import fresh
from memspark.session import materialize, ship_package

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
SEED = 42
#: The knapsack's budget; even shares and whole lengths bring the gap below it first.
KNAPSACK_WORDS = 1 << 14
_SLICES = 256


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words wanted of each source: weights in code-point order (null last), stopped at ``most`` times the size.

    What a stopped source leaves is dealt again by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
        left = max(0.0, left - sum(out[s] for s in full))
        open_ = [s for s in open_ if s not in out]
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, bound: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come to the budget, or next to it."""
    total = int((lengths * counts).sum())
    took = np.zeros(len(lengths), dtype=np.int64)
    if total <= 0 or budget <= 0:
        return took
    if budget >= total:
        return counts.copy()
    even = max(0, budget - bound // 4)  # the rest is the knapsack's
    shares = [n * even // total for n in accumulate(map(int, counts))]  # what one length loses to rounding the next one gets
    took = np.diff(np.array([0, *shares], dtype=np.int64))
    gap = budget - int((lengths * took).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if gap < 0 < took[i] and lengths[i] > 0:
            less = min(int(took[i]), -(gap // int(lengths[i])))
            took[i] -= less
            gap += less * int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):  # whole lengths, longest first, down to the bound
        if lengths[i] > 0 and gap > bound:
            more = min(int(counts[i] - took[i]), (gap - bound) // int(lengths[i]))
            took[i] += more
            gap -= more * int(lengths[i])
    # Bounded knapsack: bit b of a state is set if b words can be reached with the parts so far.
    # Sums up to twice the gap are followed, as the nearest one may lie above it.
    most = 2 * gap
    mask, states, parts = (1 << (most + 1)) - 1, [1], []
    for i in np.argsort(lengths, kind="stable"):
        size, free = int(lengths[i]), int(counts[i] - took[i])
        if size <= 0 or size > most or free <= 0:
            continue
        free, step = min(free, most // size), 1
        while free > 0 and not states[-1] >> gap & 1:
            use = min(step, free)
            states.append((states[-1] | states[-1] << (use * size)) & mask)
            parts.append((i, use))
            free, step = free - use, step * 2
    at = (states[-1] & ((1 << (gap + 1)) - 1)).bit_length() - 1
    above = states[-1] >> (gap + 1)
    if above and (over := (above & -above).bit_length()) < gap - at:
        at = gap + over
    for k in range(len(parts) - 1, -1, -1):
        if not states[k] >> at & 1:
            i, use = parts[k]
            took[i] += use
            at -= use * int(lengths[i])
    return took


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, those taken twice twice; all columns stay.

    Rows that repeat an id share the copies of all of them.
    """
    key, copies, rows, place, n = fresh(docs, "key", "copies", "rows", "place", "n")
    taken = mix(docs, id_col, text_col, source_col, **how).groupBy(F.col(id_col).alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    met = docs.join(taken, docs[id_col].eqNullSafe(F.col(key)))
    met = met.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.length(text_col))))
    each = F.floor(F.col(copies) / F.col(rows)) + (F.col(place) <= F.col(copies) % F.col(rows)).cast("int")
    return met.withColumn(n, F.explode(F.array_repeat(F.lit(0), each.cast("int")))).select(docs.columns)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken): copies 0, 1 or 2 for each row.

    Null texts have size 0, null sources form one source, rows without words are never taken.
    Rows that repeat wholly are ranked like any others. The sources' totals, one row for each
    source, are the only thing that the driver gathers. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("r"))
    own = materialize(own, "sizes").withColumn("slice", F.pmod("r", F.lit(_SLICES)))
    sizes = {x.source: int(x.n) for x in own.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(sizes, weights, share)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        name = part["source"].iloc[0]
        name = None if pd.isna(name) else name
        size = sizes[name]
        whole = int(wanted[name] // size) if size else 0
        part = part.sort_values("size")
        extra = fit_lengths(part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), round(wanted[name] - whole * size))
        return part[["source", "size"]].assign(whole=whole, extra=extra, source_size=size, target=float(wanted[name]))

    counts = own.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    plan = counts.groupBy("source", "size").agg(F.sum("n").alias("n")).groupBy("source").applyInPandas(solve, "source string, size bigint, whole bigint, extra bigint, source_size bigint, target double")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).alias("o")
    plan = plan.alias("p")
    offsets = offsets.join(plan, F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("o.size") == F.col("p.size"))).select("o.source", "o.size", "slice", "before", "whole", "extra", "source_size", "target").alias("o")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("r", "id"))
    ranked = own.withColumn("rank", rank).alias("d")
    joined = ranked.join(offsets, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.size") == F.col("o.size")) & (F.col("d.slice") == F.col("o.slice")))
    copies = F.col("whole") + F.when(F.col("rank") + F.col("before") <= F.col("extra"), 1).otherwise(0)
    copies = F.when(F.col("d.size") > 0, copies).otherwise(0).cast("bigint")
    return joined.select(F.col("id").alias(id_col), F.col("d.source").alias("source"), F.col("d.size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"))
