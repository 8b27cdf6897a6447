"""Token ids in grammar-compressed shards (Re-Pair), with random access.

A shard is one row of a Parquet folder: up to ``SHARD_IDS`` ids of whole documents in ascending
order (a longer document is a shard of its own).  Pairs of neighbouring symbols that occur ``LEAST``
times are replaced by nonterminals until no pair does.  A round counts all pairs of the shard and takes
many at once: pairs such that no symbol opens one and closes another, so replacements never overlap;
of a run of equal symbols every second pair counts.

File format, columns: task, shard (order of the shard within the task), first (ids before it within
the task), ids (count), doc_id (array), ends (end of each document within the shard), terminals (ids
are below it), left and right (the rules: nonterminal ``terminals + k`` stands for left[k] right[k]),
expands (ids that nonterminal k stands for), wide (symbols have 4 bytes, else 2), symbols
(little-endian unsigned).  Tasks and shards in order hold the documents by doc_id.

Defined results: a null text is empty; an empty document is its end id; null doc_ids come first, and
equal doc_ids by a hash of their text; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bytebpe import shared_encoder
from .common import lean, shared_dir, slices, tidy

SHARD_IDS = 1 << 19
#: Occurrences that make a pair frequent.
LEAST = 32
SCHEMA = "task int, shard int, first long, ids long, doc_id array<long>, ends array<long>, terminals int, left array<int>, right array<int>, expands array<int>, wide boolean, symbols binary"
_LISTS = {"doc_id": pa.int64(), "ends": pa.int64(), "left": pa.int32(), "right": pa.int32(), "expands": pa.int32()}
_PLAIN = {"task": pa.int32(), "shard": pa.int32(), "first": pa.int64(), "ids": pa.int64(), "terminals": pa.int32(), "wide": pa.bool_(), "symbols": pa.binary()}
ARROW = pa.schema([(n, pa.list_(_LISTS[n]) if n in _LISTS else _PLAIN[n]) for n in (x.split()[0] for x in SCHEMA.split(", "))])


def _pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray, follows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, occurrences, places, pair at each place) of the pairs (a, b) that begin ``at`` places in order; rare ones may lack.

    ``follows``: whether a place directly follows the one before.  Pairs are counted by hash bucket; of a full bucket the
    pair that stands last is counted by comparison, others by sorting.
    """
    equal, second = np.flatnonzero(a == b), None
    if len(equal) > 1:  # every second pair of a run
        number = np.arange(len(equal))
        begins = np.concatenate([[True], (equal[1:] != equal[:-1] + 1) | ~follows[equal[1:]]])
        second = equal[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 1]
    bits = max(10, len(at).bit_length())
    bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - bits)
    full = np.bincount(bucket, minlength=1 << bits) >= least
    slots = int(full.sum())
    slot = np.full(1 << bits, -1, np.int32)
    slot[full] = np.arange(slots)
    where = slot.take(bucket)
    if second is not None:
        where[second] = -1
    found = np.flatnonzero(where >= 0)
    at, where, a, b = (x.take(found) for x in (at, where, a, b))
    key = a.astype(np.uint64) << np.uint64(32) | b
    pair = np.zeros(slots, np.uint64)
    pair[where] = key
    others = np.flatnonzero(pair[where] != key)
    if len(others):
        more, back = np.unique(key[others], return_inverse=True)
        where[others] = slots + back
        pair = np.concatenate([pair, more])
    return pair, np.bincount(where, minlength=len(pair)), at, where


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right) of a grammar whose expansion is ``ids``; ids are below ``first``.  No pair of symbols is frequent.

    Places keep their numbers: ``after`` and ``before`` name the neighbours, so a round costs what it counts.
    """
    n = len(ids)
    symbols, gone = ids.astype(np.uint32), np.zeros(n, bool)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    known, at = first, np.arange(max(0, n - 1), dtype=np.int64)
    a, b, follows = symbols[:-1], symbols[1:], np.ones(max(0, n - 1), bool)
    while len(at):
        pair, number, at, where = _pairs(a, b, at, follows, least)
        opens: set[int] = set()
        closes: set[int] = set()
        frequent = np.flatnonzero(number >= least)
        frequent = frequent[np.lexsort((pair[frequent], -number[frequent]))]
        a_of, b_of = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new: list[int] = []
        for k, x, y in zip(frequent.tolist(), a_of[frequent].tolist(), b_of[frequent].tolist()):
            if x not in closes and y not in opens and (x != y or x not in opens):
                opens.add(x)
                closes.add(y)
                new.append(k)
        if not new:
            break
        chosen = np.full(len(pair), -1, np.int64)
        chosen[frequent] = -2  # to be counted again
        chosen[new] = known + np.arange(len(new))
        named = chosen.take(where)
        hit = np.flatnonzero(named >= 0)
        place = at.take(hit)
        waits = at.take(np.flatnonzero(named == -2))
        again = np.zeros(n + 1, bool)
        again[waits] = again[after.take(waits)] = True  # a run may begin elsewhere now
        symbols[place] = named.take(hit)
        second = after.take(place)
        gone[second] = True
        third = after.take(second)
        after[place] = third
        inside = third < n
        before[third[inside]] = place[inside]
        again[place] = again[before.take(place)] = True
        again[second] = again[n] = False
        at = np.flatnonzero(again)
        then = after.take(at)
        if len(then) and then[-1] == n:
            at, then = at[:-1], then[:-1]
        a, b = symbols.take(at), symbols.take(then)
        follows = np.concatenate([[False], at[1:] == then[:-1]])
        left.append(a_of[new])
        right.append(b_of[new])
        known += len(new)
    empty = [np.zeros(0, np.int64)]
    return symbols[~gone], np.concatenate(left or empty).astype(np.int32), np.concatenate(right or empty).astype(np.int32)


def lengths_of(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    size: list[int] = []
    for a, b in zip(left.tolist(), right.tolist()):
        size.append((size[a - first] if a >= first else 1) + (size[b - first] if b >= first else 1))
    return np.array(size, np.int64)


class Grammar:
    """Reads the ids of a shard, whole or any span of them."""

    def __init__(self, left: np.ndarray, right: np.ndarray, expands: np.ndarray, symbols: np.ndarray, first: int):
        self.first, self.left, self.right, self.expands, self.symbols = first, left, right, expands, symbols.astype(np.int64)
        self.upto, self.flat = np.concatenate([[0], np.cumsum(self.sizes(self.symbols))]), None

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out, rule = np.ones(len(symbols), np.int64), symbols >= self.first
        out[rule] = self.expands[symbols[rule] - self.first]
        return out

    def opened(self, symbols: np.ndarray) -> np.ndarray:
        """What symbols stand for, one rule at a time."""
        size = self.sizes(symbols)
        at, out = np.cumsum(size) - size, np.empty(int(size.sum()), np.uint32)
        while len(symbols):  # each round writes what is a terminal and opens the rest by one rule
            rule = symbols >= self.first
            out[at[~rule]] = symbols[~rule]
            symbols, at = symbols[rule] - self.first, at[rule]
            left = self.left[symbols]
            symbols, at = np.concatenate([left, self.right[symbols]]), np.concatenate([at, at + self.sizes(left)])
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes(symbols)
        to = np.cumsum(size) - size
        if self.expands.sum() > 2 * (to[-1] + size[-1]):
            return self.opened(symbols)
        if self.flat is None:  # the rules are opened once, and looked up
            self.flat = self.opened(self.first + np.arange(len(self.left)))
            self.begin = np.cumsum(self.expands) - self.expands
        out = np.repeat(symbols, size).astype(np.uint32)
        rule = np.flatnonzero(size > 1)
        size, begin, to = size[rule], self.begin[symbols[rule] - self.first], to[rule]
        own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + own] = self.flat[np.repeat(begin, size) + own]
        return out

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """ids[a:b], expanding only the symbols that reach into the span."""
        b = int(self.upto[-1]) if b is None else b
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = int(np.searchsorted(self.upto, a, "right")) - 1, int(np.searchsorted(self.upto, b, "left"))
        return self.expand(self.symbols[i:j])[a - int(self.upto[i]) : b - int(self.upto[i])]


def grammar_of(row: dict) -> Grammar:
    rules = (np.array(row[x], np.int64) for x in ("left", "right", "expands"))
    return Grammar(*rules, np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2"), row["terminals"])


def _shard(task: int, shard: int, first: int, ids: np.ndarray, doc_ids: list, ends: list[int]) -> pa.RecordBatch:
    terminals = int(ids.max()) + 1
    symbols, left, right = compress(ids, terminals)
    wide = terminals + len(left) > 1 << 16
    row = {"task": task, "shard": shard, "first": first, "ids": len(ids), "doc_id": doc_ids, "ends": ends, "terminals": terminals, "left": left, "right": right, "expands": lengths_of(left, right, terminals), "wide": wide, "symbols": symbols.astype("<u4" if wide else "<u2").tobytes()}
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in ARROW], schema=ARROW)


def _write_task(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = shared_encoder(tokenizer), TaskContext.get().partitionId()
        parts: list[np.ndarray] = []
        doc_ids: list = []
        ends: list[int] = []
        size, shard, first = 0, 0, 0
        for batch in batches:
            own, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 3_000_000):
                ids, bounds = encoder.encode(texts[a:b])
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                for i in range(b - a):
                    n = int(bounds[i + 1] - bounds[i])
                    if size and size + n > SHARD_IDS:
                        yield _shard(task, shard, first, np.concatenate(parts), doc_ids, ends)
                        shard, first, size, parts, doc_ids, ends = shard + 1, first + size, 0, [], [], []
                    size += n
                    parts.append(ids[bounds[i] : bounds[i + 1]])
                    doc_ids.append(own[a + i])
                    ends.append(size)
        if size:
            yield _shard(task, shard, first, np.concatenate(parts), doc_ids, ends)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the shards of all documents to a folder that all executors share."""
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(tidy(_write_task(tokenizer, end_id)), SCHEMA).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids when asked for, from the files."""
    shards = spark.read.parquet(path)
    # one row for each task that wrote
    base = shards.groupBy("task").agg(F.sum("ids").alias("n")).select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    schema = "task int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = grammar_of(row).ids().astype("<u4").tobytes()
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                spans = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(np.full(len(ends), row["task"], np.int32)), pa.array(row["doc_id"], pa.int64()), pa.array(starts + row["first"]), pa.array(ends - starts), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(spans, pa.binary())] if with_ids else [])], names=["task", "doc_id", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    found = shards.select("task", "first", "doc_id", "ends", "terminals", "left", "right", "expands", "wide", "symbols").mapInArrow(tidy(run), schema)
    return found.join(base, "task").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def folder(spark: SparkSession) -> str:
    """A new folder for shards in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
