"""Packing token ids into sequences of fixed length.

Each task keeps ``open_windows`` sequences open.  A document first gives away whole sequences; its
rest goes to the open window that it fills best.  Where none has room the fullest window is emitted:
with up to ``slack`` ids of padding as it is, else filled to the brim with the head of the incoming
piece.  At the end of a task the open windows are merged, which leaves at most one that is not full;
these last windows meet in groups of ``FAN_IN`` tasks, level by level, so no task ever holds more
than ``FAN_IN`` sequences of leftovers however many rows there are.

Defined results: a null text is empty; an empty document is one piece, its end id; repeated rows and
equal doc_ids are packed row by row; a null doc_id stays null; an empty table gives no rows; other
columns of the input are ignored.  The same input files and settings give the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import shared_encoder
from .common import lean, settled, slices, tidy

FAN_IN = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long, open boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([pa.field(n, pa.binary() if n == "ids" else pa.bool_() if n == "open" else pa.int64()) for n in NAMES])


class Windows:
    """Open sequences of one task.  ``close`` gets (sequence number, pieces, used) for each that is done.

    A piece is (doc_id, start, ids, doc_tokens).
    """

    def __init__(self, size: int, most: int, slack: int):
        self.size, self.most, self.slack = size, most, slack
        self.open: list[list] = []  # [free, pieces]
        self.done: list[list] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        at, n = 0, len(ids)
        while n - at >= self.size:
            self.done.append([(doc_id, start + at, ids[at : at + self.size], total)])
            at += self.size
        while at < n:
            at += self._place(doc_id, start + at, ids[at:], total)

    def _place(self, doc_id, start: int, ids: np.ndarray, total: int) -> int:
        need, best, fullest = len(ids), None, None
        for w in self.open:
            if w[0] >= need and (best is None or w[0] < best[0]):
                best = w
            if fullest is None or w[0] < fullest[0]:
                fullest = w
        if best is None:
            if len(self.open) < self.most:
                self.open.append(best := [self.size, []])
            elif fullest[0] <= self.slack:
                self._close(fullest)
                return 0
            else:
                need, best = fullest[0], fullest
        best[1].append((doc_id, start, ids[:need], total))
        best[0] -= need
        if best[0] == 0:
            self._close(best)
        return need

    def _close(self, w: list) -> None:
        self.open = [x for x in self.open if x is not w]
        self.done.append(w[1])

    def merge(self) -> None:
        """Fills all open windows from one another, largest pieces first; at most one stays open."""
        pieces = [p for w in self.open for p in w[1]]
        self.open, most, slack = [], self.most, self.slack
        self.most, self.slack = 1, 0
        for p in sorted(pieces, key=lambda p: -len(p[2])):
            self.add(*p)
        self.most, self.slack = most, slack


def _rows(sequences: list[list], first: int, is_open: bool, task: int, with_ids: bool) -> pa.RecordBatch:
    out: list[list] = [[] for _ in NAMES]
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), total, first + k, offset, raw if with_ids or is_open else None, task, is_open)):
                column.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW)], schema=ARROW)


def _pack_task(path: str, size: int, most: int, slack: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = shared_encoder(path), TaskContext.get().partitionId()
        windows, made = Windows(size, most, slack), task << 32
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 3_000_000):
                ids, ends = encoder.encode(texts[a:b])
                for i in range(b - a):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id))
                    windows.add(doc_ids[a + i], 0, own, len(own))
                yield _rows(windows.done, made, False, task, with_ids)
                made, windows.done = made + len(windows.done), []
        windows.merge()
        yield _rows(windows.done, made, False, task, with_ids)
        yield _rows([w[1] for w in windows.open], made + len(windows.done), True, task, with_ids)

    return run


def _merge_group(size: int, level: int, with_ids: bool):
    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        task = batch.column("task")[0].as_py() // FAN_IN
        windows = Windows(size, 1, 0)
        pieces = [[r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]] for r in batch.to_pylist()]
        windows.open = [[0, pieces]]
        windows.merge()
        first = level << 58 | task << 32
        tables = [_rows(windows.done, first, False, task, with_ids), _rows([w[1] for w in windows.open], first + len(windows.done), True, task, with_ids)]
        return pa.Table.from_batches(tables)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, open_windows: int = 32, slack: int = 8, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids when ``with_ids``.

    ``docs`` needs doc_id and text.  ``ids`` holds little-endian unsigned 32-bit ids.  A sequence is its
    pieces by offset; a loader pads it to ``size``.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_pack_task(tokenizer, size, open_windows, slack, end_id, with_ids)), SCHEMA)
    done, level = None, 0
    while True:
        rows = settled(rows)
        last = rows.filter("open").agg(F.max("task"), F.count_distinct("task")).first()
        if (last[1] or 0) <= 1:
            done = rows if done is None else done.unionByName(rows)
            break
        level += 1
        closed = rows.filter("not open")
        done = closed if done is None else done.unionByName(closed)
        rows = rows.filter("open").groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(_merge_group(size, level, with_ids), SCHEMA)
    kept = [n for n in NAMES if n not in ("task", "open") and (with_ids or n != "ids")]
    return done.select(*kept)
