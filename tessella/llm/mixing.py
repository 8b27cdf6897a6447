"""Mixing sources to target weights, to the word.

Targets: sources by code point, null last, have the weights 5, 2, 1, repeating, and share the size of
all documents; none gets more than ``most`` times its source's size, and the excess is shared by
weight among the others until none is above.

Takes: a source is taken whole as often as its target has room.  For the rest its documents are
counted by exact length.  Of every length the same share is taken, rounded down; one more document at
a time of the longest lengths follows while it fits; what is then left is a small budget, which a
bounded knapsack over the documents not yet counted fits as closely as they allow (a bit set of
reachable sums, and for each sum the step that first reached it, so that the choice can be read back).
Sums beyond twice the budget are no nearer than none, so a very long text doesn't widen it.  Which
documents of a length are taken is decided by a seeded hash of doc_id and text.

Counting and choosing are distributed: the k documents of a (source, length) with the least hashes
are found from counts by hash bucket, and only the bucket that holds the k-th is ranked, so many
documents of one length meet in one task only where they are copies with one doc_id.  The driver sees
one row per source.

Defined results: a null text has size 0; a null source is a source of its own; repeated rows are
documents of their own; an empty table gives no rows; other columns of the input are ignored (``mixed``
hands them through, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, settled, whole_row

#: The weights, dealt in turn.
WEIGHTS = (5, 2, 1)
#: Sources that the driver may see, one row each.
MOST_SOURCES = 1_000_000
BUCKETS = 1024
#: The knapsack fits a budget up to this; the longest-first step leaves less than one document above it.
BUDGET = 65_536


def targets(sizes: dict[str | None, int], most: float = 3.0, weights: tuple = WEIGHTS) -> dict[str | None, float]:
    """Target of each source, given the sizes."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, open_ = float(sum(sizes.values())), list(order)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: share * weight[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, most: int = BUDGET) -> list[int]:
    """How many documents of each length to take (at most ``counts``) so that their sum comes near ``budget``."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [c * budget // total if n else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(n * k for n, k in zip(lengths, take))
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    while left > most:
        before = left
        for i in order:
            if lengths[i] <= left - most // 2 and take[i] < counts[i]:
                more = 1 if left - lengths[i] <= most else max(1, min(counts[i] - take[i], (left - most // 2) // lengths[i]) // 2)
                take[i], left = take[i] + more, left - more * lengths[i]
            if left <= most:
                break
        if left == before:
            break
    # A document may stand above the budget: the nearest sum counts, on either side.
    cap = min(left + max(lengths), 2 * left)
    reach, steps, mask = 1, [], (1 << (cap + 1)) - 1
    first = np.full(cap + 1, -1, np.int32)
    for i in order:
        spare, unit = counts[i] - take[i], 1
        while spare > 0 and unit * lengths[i] <= cap:
            k = min(unit, spare)
            if k * lengths[i] <= cap and (new := (reach << (k * lengths[i])) & mask & ~reach):
                first[_ones(new, cap + 1)] = len(steps)
                steps.append((i, k))
                reach |= new
            spare, unit = spare - k, unit * 2
        if reach >> left & 1:
            break
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    best = left + (above & -above).bit_length() if above and (above & -above).bit_length() < left - low else low
    while best:
        i, k = steps[first[best]]
        best -= k * lengths[i]
        take[i] += k
    return take


def _ones(bits: int, size: int) -> np.ndarray:
    """Places of the ones of a bit set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little"))


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    budget = int(round(float(group["budget"].iloc[0])))
    group = group.sort_values("size")
    group["k"] = fit(group["size"].tolist(), group["n"].tolist(), budget)
    return group[["source", "size", "k"]]


def mix(docs: DataFrame, seed: int = 7, most: float = 3.0, weights: tuple = WEIGHTS, size: Column | None = None, *keep: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the ``keep`` columns."""
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long") if size is None else size
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.alias("size"), hashed.alias("h"), F.pmod(hashed, F.lit(BUCKETS)).cast("int").alias("bucket"), F.struct(F.lit(0).alias("__"), *(f"`{c}`" for c in keep)).alias("kept"))
    rows = settled(rows)
    counts = settled(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), 4)
    sizes = {r[0]: int(r[1] or 0) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size"))).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets(sizes, most, weights)
    plan = [(s, sizes[s], goal[s], int(min(most, goal[s] // sizes[s])) if sizes[s] else 0) for s in sizes]
    # a null source has no equal in a join: it gets a name that starts as no source's name does
    name = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "source"))
    by_source = spark.createDataFrame([("null" if s is None else f"={s}", *x, x[1] - x[2] * x[0]) for s, *x in plan], "source string, source_size long, target double, whole int, budget double") if plan else spark.createDataFrame([], "source string, source_size long, target double, whole int, budget double")
    by_source = settled(by_source, 16)
    counts, rows = counts.withColumn("source", name), rows.withColumn("source", name)
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n")).join(by_source.select("source", "budget"), "source")
    chosen = settled(lengths.groupBy("source").applyInPandas(_fit_source, "source string, size long, k long"), 16)
    # of each (source, size): buckets before the k-th document are taken whole, its own in part
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    upto = counts.join(chosen, ["source", "size"]).withColumn("before", F.coalesce(before, F.lit(0)))
    share = settled(upto.select("source", "size", "bucket", F.greatest(F.lit(0), F.least("n", F.col("k") - F.col("before"))).alias("share"), "n").filter("share > 0"), 8)
    dealt = rows.join(share, ["source", "size", "bucket"], "left")
    whole, none = F.col("share") == F.col("n"), F.col("share").isNull()
    partly = dealt.filter(~whole & ~none).withColumn("r", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", "kept"))).withColumn("once", (F.col("r") <= F.col("share")).cast("long")).drop("r")
    marked = dealt.filter(none | whole).withColumn("once", F.when(whole, 1).otherwise(0).cast("long")).unionByName(partly)
    return marked.join(by_source.drop("budget"), "source").select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("once"))).alias("taken"), *(F.col("kept").getField(c).alias(c) for c in keep))


def mixed(docs: DataFrame, seed: int = 7, most: float = 3.0, weights: tuple = WEIGHTS) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; those without a word never."""
    marked = settled(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("number")))
    plain = marked.select(*(F.col("row").getField(c).alias(c) for c in ("doc_id", "source", "text")), "number")
    times = mix(plain, seed, most, weights, None, "number").filter("taken > 0").select("number", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return marked.join(times, "number").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
