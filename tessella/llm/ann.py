"""Nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the quantiser of residuals are fitted on at most about ``SAMPLE`` vectors, taken
by hash (documented bound); every vector is indexed, with its code, the length of what the code leaves
out, and its cosine with its centroid.  Cells grow with the root of the rows up to ``MOST_CELLS``.

What a query passes over can't be among its k nearest, whatever the rows are like.  A first search of the
cells about its own gives the k-th best score so far.  Then it probes each cell whose bound reaches that:
by the triangle inequality on angles, no vector of a cell is nearer than the query's angle to the centroid
less the largest (or the smallest less it) of the cell's.  In a cell codes are scored against the query
(asymmetric distance), the best ``shortlist`` are scored exactly, in double precision, on the original
vectors, and so is each vector whose score by code plus the length left out reaches the k-th best.  Where
vectors have no structure, bounds spare little and most cells are probed.  ``probe`` limits a query to so many
of its nearest cells (more while these hold fewer than ``k`` + 1 vectors), which gives exactness up.

Cells that lie together are dealt out in lots of ``LOT`` vectors, large ones over several, by ``QUERIES``
queries, so no task holds a cell or its queries whole.  Of equal vectors the k + 1 with the least ids are
indexed: no other can be among the k nearest of anything.

Defined results: vectors that are null, empty, zero, of another length than the most frequent, or that
hold null or non-finite components take no part, also as queries; fewer candidates than k give all;
ties go to the smaller id; repeated rows (same id and vector) count once,
also as queries, and of several vectors with one id the best counts; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import settled, tidy

SAMPLE, SHORTLIST = 16_384, 32
LEAST_CELLS, MOST_CELLS = 16, 1024
#: Vectors of a lot, least and most, and queries that meet one in a task.
LOT, QUERIES = (8192, 65_536), 32_768
#: Vectors and queries that are scored at once, and pairs of them that are scored exactly.
BLOCK, ASKED, PAIRS = 8192, 1024, 65_536
#: Dimensions of a sub-vector, and code words for each.
PART, WORDS = 4, 256


@dataclass
class Quantiser:
    centroids: np.ndarray  # [cells, d]
    books: np.ndarray  # [parts, words, PART], of residuals; the last part is padded

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(axis=1).astype(np.int32)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = _padded(x - self.centroids[cell]).reshape(len(x), -1, PART)
        return np.stack([((b * b).sum(axis=1) - 2 * rest[:, k] @ b.T).argmin(axis=1) for k, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        rest = np.concatenate([b[code[:, k]] for k, b in enumerate(self.books)], axis=1)
        return self.centroids[cell] + rest[:, : self.centroids.shape[1]]


@dataclass
class Cells:
    """What is known of the cells: vectors, least and largest cosine with the centroid, first lot and lots."""

    centroids: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray
    lot: np.ndarray
    lots: np.ndarray
    probe: int | None
    k: int

    def home(self, near: np.ndarray) -> np.ndarray:
        return np.where(self.count > 0, near, -np.inf).argmax(axis=1)

    def reach(self, near: np.ndarray) -> np.ndarray:
        """[queries, cells]: no vector of the cell has a larger cosine with the query; -inf where it isn't to be probed."""
        at, inner, outer = (np.arccos(np.clip(x, -1, 1)) for x in (near, self.most, self.least))
        out = np.cos(np.maximum(0, np.maximum(at - outer, inner - at))) + 1e-7
        out[:, self.count == 0] = -np.inf
        if self.probe is not None:
            order = np.argsort(-near, axis=1, kind="stable")
            enough = (np.cumsum(self.count[order], axis=1) - self.count[order]) < self.k + 1
            there = np.zeros(near.shape, bool)
            np.put_along_axis(there, order, enough | (np.arange(order.shape[1]) < self.probe), axis=1)
            out[~there] = -np.inf
        return out


class Best:
    """The k best of each query so far: of each id its best score, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.ids, self.scores, self.k = np.zeros((queries, k), np.int64), np.full((queries, k), -np.inf), k

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.unique(q)
        q, ids, scores = np.concatenate([q, np.repeat(rows, self.k)]), np.concatenate([ids, self.ids[rows].ravel()]), np.concatenate([scores, self.scores[rows].ravel()])
        there = np.isfinite(scores)
        q, ids, scores = q[there], ids[there], scores[there]
        for keys in ((-scores, ids, q), None):
            order = np.lexsort(keys or (ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            if keys:
                new = np.ones(len(q), bool)
                new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
                q, ids, scores = q[new], ids[new], scores[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.scores[rows] = -np.inf
        self.ids[q[kept], rank[kept]], self.scores[q[kept], rank[kept]] = ids[kept], scores[kept]


@dataclass
class Part:
    """Vectors of a cell, as indexed."""

    ids: np.ndarray
    unit: np.ndarray
    known: np.ndarray  # what the codes stand for, in single precision
    left: np.ndarray  # length of the rest

    def search(self, best: Best, rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, shortlist: int) -> None:
        """Adds what may be among the k best of the queries ``rows``, which have vectors ``q`` and ids alike."""
        k, d = best.k, q.shape[1]
        slack = 1e-6 + 3e-7 * d  # single precision

        def add(i: np.ndarray, j: np.ndarray) -> None:
            for a in range(0, len(i), PAIRS):
                x, y = i[a : a + PAIRS], j[a : a + PAIRS]
                other = self.ids[y] != query_ids[x]
                x, y = x[other], y[other]
                best.add(rows[x], self.ids[y], (self.unit[y] * q[x]).sum(axis=1))

        by_code = q.astype(np.float32) @ self.known.T
        reached = np.maximum(floor, best.scores[rows, -1])
        if np.isneginf(reached).any():
            n = min(len(self.ids), shortlist + 1)
            near = np.argpartition(-by_code, n - 1, axis=1)[:, :n]
            add(np.repeat(np.arange(len(q)), n), near.ravel())
            reached = np.maximum(floor, best.scores[rows, -1])
        may = by_code + self.left >= (reached - slack)[:, None]
        if 20 * np.count_nonzero(may) < may.size:
            add(*np.nonzero(may))
            return
        some = np.flatnonzero(may.any(axis=0))
        score = q @ self.unit[some].T
        score[self.ids[some] == query_ids[:, None]] = -np.inf
        if len(some) > k and np.count_nonzero(score >= reached[:, None]) > 4 * k * len(q) and len(np.unique(self.ids[some])) == len(some):
            reached = np.maximum(reached, np.partition(score, len(some) - k, axis=1)[:, len(some) - k])
        i, j = np.nonzero(score >= (reached - 1e-11)[:, None])
        add(i, some[j])


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART)))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of huge or tiny components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _means(x: np.ndarray, k: int, rounds: int, rng, spherical: bool) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T if spherical else 2 * x @ centre.T - (centre * centre).sum(axis=1)).argmax(axis=1)
        count = np.bincount(near, minlength=len(centre))
        total = np.stack([np.bincount(near, x[:, d], len(centre)) for d in range(x.shape[1])], axis=1)
        full = count > 0
        centre[full] = total[full] / count[full, None]
        if spherical:
            size = np.sqrt((centre * centre).sum(axis=1, keepdims=True))
            centre /= np.where(size > 0, size, 1)
    return centre


def cells_for(rows: int) -> int:
    """Half the root of the rows, as a power of two."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, rows) ** 0.5 / 2)))))


def lots_for(centroids: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first lot, lots) of each cell: cells are halved along their longest axis until a half holds at most ``size`` vectors."""
    lot, lots, made = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), 0
    todo = [np.flatnonzero(count > 0)]
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and count[cells].sum() > size:
            x = centroids[cells] - centroids[cells].mean(axis=0)
            cells = cells[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
            half = np.cumsum(count[cells])
            at = min(len(cells) - 1, int(np.searchsorted(half, half[-1] / 2)) + 1)
            todo += [cells[at:], cells[:at]]
        elif len(cells):
            lot[cells], lots[cells] = made, max(1, -(-int(count[cells].sum()) // size)) if len(cells) == 1 else 1
            made += int(lots[cells[0]])
    return lot, lots


def fit(x: np.ndarray, cells: int, seed: int = 7) -> Quantiser:
    """Fits a quantiser to unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = _means(x, cells, 8, rng, True)
    rest = _padded(x - centroids[(x @ centroids.T).argmax(axis=1)]).reshape(len(x), -1, PART)
    books = [_means(rest[:, p], WORDS, 6, rng, False) for p in range(rest.shape[1])]
    return Quantiser(centroids, np.stack([np.pad(b, ((0, WORDS - len(b)), (0, 0)), mode="edge") for b in books]))


def usable(vector: Column) -> Column:
    """Not null, and all components finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", cells: int | None = None, probe: int | None = None, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``queries`` (of vec_id) holds, against all other rows."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return nothing
    rows = rows.filter(F.col("d") == common["d"]).select("vec_id", "v")
    cells = cells or cells_for(common["count"])
    share = min(1.0, SAMPLE / common["count"])
    part = F.pmod(F.xxhash64(F.lit("fit"), "vec_id", "v"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(part < share).orderBy("vec_id").toArrow()
    sample = sample if sample.num_rows else rows.orderBy("vec_id").limit(cells).toArrow()
    sample = np.unique(_unit(_matrix(sample["v"])), axis=0)
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    model = fit(sample, cells)
    shared = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(1))) if b.num_rows else np.zeros((0, common["d"]))
            cell = shared.value.cells(x)
            code = shared.value.codes(x, cell)
            rest = x - shared.value.decoded(cell, code)
            near = (x * shared.value.centroids[cell]).sum(axis=1)
            columns = [pa.array(cell), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.sqrt((rest * rest).sum(axis=1))), pa.array(near)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["vec_id", "v", "cell", "code", "left", "near"])

    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    distinct = rows.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("vec_id", "v")
    base = settled(distinct.mapInArrow(tidy(index), f"vec_id long, v {kind}, cell int, code binary, left double, near double"))
    count, least, most = np.zeros(len(model.centroids), np.int64), np.ones(len(model.centroids)), np.ones(len(model.centroids))
    for r in base.groupBy("cell").agg(F.count("*"), F.min("near"), F.max("near")).collect():  # one row for each cell
        count[r[0]], least[r[0]], most[r[0]] = r[1:]
    size = min(LOT[1], max(LOT[0], int(count.sum()) // 64))
    known = Cells(model.centroids, count, least, most, *lots_for(model.centroids, count, size), probe, k)
    n_lots = int((known.lot + known.lots).max())
    holds = np.zeros((len(count), n_lots), np.float32)
    for c in np.flatnonzero(count):
        holds[c, known.lot[c] : known.lot[c] + known.lots[c]] = 1

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the lot of its nearest cell."""
        for b in batches:
            for a in range(0, b.num_rows, ASKED):
                part = b.slice(a, ASKED)
                home = known.home(_unit(_matrix(part.column(1))) @ known.centroids.T)
                lot = known.lot[home] + part.column(0).to_numpy() % known.lots[home]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, -np.inf)), pa.array(lot.astype(np.int32))], names=["query_id", "v", "floor", "lot"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the other lots that may hold something nearer than its k-th best."""
        for b in batches:
            for a in range(0, b.num_rows, ASKED):
                part = b.slice(a, ASKED)
                floor = part.column(2).to_numpy()
                there = (known.reach(_unit(_matrix(part.column(1))) @ known.centroids.T) >= np.maximum(floor, -2)[:, None]).astype(np.float32) @ holds > 0
                there[np.arange(len(floor)), part.column(3).to_numpy()] = False
                row, lot = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(3)), pa.array(lot.astype(np.int32))], names=["query_id", "v", "floor", "lot"])

    def best_of(left: pa.Table, right: pa.Table) -> Best:
        best = Best(right.num_rows, k)
        if not left.num_rows or not right.num_rows:
            return best
        left = left.sort_by("cell")
        cell, ids, unit = left["cell"].to_numpy(), left["vec_id"].to_numpy(), _unit(_matrix(left["v"]))
        code = np.stack([np.frombuffer(c, np.uint8) for c in left["code"].to_pylist()])
        by_code, rest = shared.value.decoded(cell, code).astype(np.float32), left["left"].to_numpy().astype(np.float32)
        cells, starts = np.unique(cell, return_index=True)
        parts = []
        for c, a, e in zip(cells, starts, [*starts[1:], len(cell)]):
            parts += [(c, Part(*(x[i : min(e, i + BLOCK)] for x in (ids, unit, by_code, rest)))) for i in range(a, e, BLOCK)]
        query_ids, floor = right["query_id"].to_numpy(), right["floor"].to_numpy()
        for a in range(0, len(floor), ASKED):
            q = _unit(_matrix(right["v"].slice(a, ASKED)))
            near = q @ known.centroids.T
            home, reach = known.home(near), known.reach(near)
            for at_home in (True, False):
                for c, part in parts:
                    asks = np.flatnonzero(((home == c) == at_home) & (reach[:, c] >= np.maximum(-2, np.maximum(floor[a : a + ASKED], best.scores[a : a + ASKED, -1]))))
                    if len(asks):
                        part.search(best, a + asks, query_ids[a + asks], q[asks], floor[a + asks], shortlist)
        return best

    def first_search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query with its lot, what was found there, and the k-th best score."""
        best = best_of(left, right)
        there = [np.isfinite(s) for s in best.scores]
        found = [pa.array([x[t] for x, t in zip(values, there)], pa.list_(kind)) for values, kind in ((best.ids, pa.int64()), (best.scores, pa.float64()))]
        return pa.table([right["query_id"], right["v"], pa.array(best.scores[:, -1]), right["lot"], *found], names=["query_id", "v", "floor", "lot", "ids", "scores"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        best = best_of(left, right)
        there = np.isfinite(best.scores)
        columns = [np.repeat(right["query_id"].to_numpy(), there.sum(axis=1)) if right.num_rows else np.zeros(0, np.int64), best.ids[there], best.scores[there]]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)

    def met(asked: DataFrame, how, schema: str) -> DataFrame:
        """Lots and their queries, brought together in tasks."""
        wanted = {r[0]: r[1] for r in asked.groupBy("lot").count().collect()}
        shares = F.array(*(F.lit(-(-wanted.get(i, 0) // QUERIES)) for i in range(n_lots)))
        lots = base.withColumn("lot", (of(known.lot.tolist()) + F.pmod(F.xxhash64("vec_id"), of(known.lots.tolist()))).cast("int")).withColumn("n", F.element_at(shares, F.col("lot") + 1)).filter("n > 0")
        dealt = lots.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("near", "n")
        asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id", "v"), F.element_at(shares, F.col("lot") + 1)).cast("int"))
        return dealt.groupBy("lot", "share").cogroup(asked.groupBy("lot", "share")).applyInArrow(how, schema)

    state = f"query_id long, v {kind}, floor double, lot int"
    asked = rows.filter(queries).dropDuplicates(["vec_id", "v"])
    begun = settled(met(asked.mapInArrow(own, state), first_search, f"{state}, ids array<long>, scores array<double>"))
    more = met(begun.select("query_id", "v", "floor", "lot").mapInArrow(others, state), search, "query_id long, vec_id long, score double")
    found = begun.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score")).unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
