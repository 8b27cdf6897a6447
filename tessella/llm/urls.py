"""URL rules by a sort-merge range join on reversed-host keys.

A rule is (host, path, verdict).  It fits a URL if the URL's host is the rule's or below it and the
URL's path starts with the rule's; the longest rule (host and path together) wins, of equally long
ones that with the longer host, then the first by code point.

A rule's key is its host's labels in reverse order, a mark, and its path, so all keys with that prefix
form an interval.  A URL stands in the sorted order once for each level of its host (org, org.example,
...), each time with its path; a rule fits exactly if its interval holds one of these points.  Points
and rules are dealt out by ranges of keys.  In a range a sweep in key order keeps a stack of the rules
whose interval is open, nested as prefixes are, and takes the best for each point.

Range bounds come from a bounded sample of the points; rules whose interval meets several ranges go
to each of them.  A key that fills several ranges, as a very frequent URL does, is dealt over all of
those at random, since each has all rules that can fit it.

Defined results: a null URL or one without "://" has an empty host and path and no rule; a URL that
no rule fits has the ``otherwise`` verdict; repeated rows get a row each; a null or empty rule table
means no rule; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Stands between host and path in a key; sorts before any label's characters, and ends a label list.
MARK = "\x01"
#: Sampled points for each range of keys, at most about; ranges at most.
PER_RANGE, RANGES = 64, 4096


def lowered(host: Column) -> Column:
    """With A-Z lower-cased, and nothing else."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, by position: after the first "://"."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, lowered(host)).otherwise(""), F.when(has, path).otherwise("")


def key(host: Column, path: Column) -> Column:
    """Reversed labels, each ended by a dot, then the mark and the path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("." + MARK), path)


def points(host: Column, path: Column) -> Column:
    """The keys of a URL, one for each level of its host."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("." + MARK), path))


def sweep(rows: Iterator[tuple[int, str, int, tuple | None]]) -> Iterator[tuple[int, tuple]]:
    """(row, best rule) from (range, key, row, rule) sorted by range and key, rules (with row -1) before points."""
    stack: list[tuple[str, tuple]] = []
    at = None
    for part, k, row, rule in rows:
        if part != at:
            at, stack = part, []
        while stack and not k.startswith(stack[-1][0]):
            stack.pop()
        if row < 0:
            stack.append((k, min(stack[-1][1], rule) if stack else rule))
        elif stack:
            yield row, stack[-1][1]


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict.  ``rules``: (host, path, verdict)."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    rows = settled(rows)
    spots = rows.filter("host <> ''").select("row", F.explode(points(F.col("host"), F.col("path"))).alias("key"))
    total = spots.count()
    ranges = max(1, min(RANGES, total // 20_000, 4 * pages.sparkSession.sparkContext.defaultParallelism))
    share = min(1.0, ranges * PER_RANGE / max(1, total))
    unit = F.pmod(F.xxhash64(F.lit("range"), "row", "key"), F.lit(1 << 30)) / (1 << 30)
    sample = [r[0] for r in spots.filter(unit < share).select("key").sort("key").collect()] if ranges > 1 else []
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    # range i holds keys from bounds[i - 1] to bounds[i]; equal bounds share a key among ranges
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, own = b.column(1).to_pylist(), b.column(0).to_numpy()
            part = np.empty(len(keys), np.int32)
            for i, (k, row) in enumerate(zip(keys, own.tolist())):
                low, high = bisect_left(bounds, k), bisect_right(bounds, k)
                part[i] = low + row % (high - low + 1)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(1), b.column(0), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int32())], names=names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for k, text, verdict, size in zip(*(b.column(i).to_pylist() for i in range(4))):
                # the interval is [k, k + highest code point]
                for part in range(bisect_left(bounds, k), bisect_right(bounds, k + "\U0010ffff") + 1):
                    for c, v in zip(out, (part, k, -1, text, verdict, size)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    names = ["part", "key", "row", "rule", "verdict", "host_chars"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    schema = "part int, key string, row long, rule string, verdict string, host_chars int"
    ruled = rules.filter("host is not null and host <> ''").select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    ruled = ruled.select(key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_chars")).mapInArrow(deal_rules, schema)
    both = spots.mapInArrow(deal, schema).unionByName(ruled).repartition("part").sortWithinPartitions("part", "key", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for part, k, row, text, verdict, size in zip(*(b.column(i).to_pylist() for i in range(6))):
                    yield part, k, row, (-len(text), -size, text, verdict) if row < 0 else None

        out: list[list] = [[], [], [], []]
        for row, rule in sweep(each()):
            for c, v in zip(out, (row, rule[2], rule[3], rule[:2])):
                c.append(v)
            if len(out[0]) >= 10_000:
                yield pack(out)
                out = [[], [], [], []]
        yield pack(out)

    def pack(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([a for a, _ in out[3]], pa.int32()), pa.array([b for _, b in out[3]], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["row", "long", "host", "rule", "verdict"])

    fits = both.mapInArrow(run, "row long, long int, host int, rule string, verdict string")
    best = fits.groupBy("row").agg(F.min(F.struct("long", "host", "rule", "verdict")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
