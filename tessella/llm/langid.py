"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of length 0 to ``ORDER``.  In a context a byte seen n times
among N costs as n / (N + q), where q is the number of different bytes seen there; q / (N + q) is the
escape probability, and the rest is dealt by the next shorter context over the bytes not seen, down
to equal shares.  The statistics are frozen after training, so each (context, byte) has an exact code
length, kept in 1/65536 bits; a text's code length under a language is a sum, in whole numbers, and
is the same however the texts are split among tasks.  The shortest code wins.

Training reads a bounded sample of labelled rows, texts whole: about ``SAMPLE`` of each language and
``TOTAL`` of all, of the ``LANGUAGES`` most frequent ones, chosen by a hash of doc_id and text, so that copies of a
row are in or out together; of each language one row at least.  The model is bounded by ``CELLS`` (64 MB of
costs): contexts seen once in all are no contexts, and beyond the bound the most frequent ones are kept.
Scoring reads every byte of every text.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing was learned;
ties go to the language first by code point; repeated rows are judged row by row; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, tidy

ORDER = 3
#: Labelled rows to learn from, for each language (on average: rows are taken by hash).
SAMPLE = 600
#: Languages to learn, the most frequent first, and rows to learn from in all.
LANGUAGES, TOTAL = 500, 60_000
#: Contexts are kept while the cost table has no more cells than this, the most frequent first.
CELLS = 16_000_000
UNIT = 65_536
#: Before a text stand as many line ends as the longest context.
PAD = b"\n" * ORDER


@dataclass
class Model:
    """``symbol``: byte -> symbol (the last is any byte never seen); ``state``: last ORDER symbols -> context; ``cost[state * symbols + symbol]``: a row of code lengths."""

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    cost: np.ndarray

    def lengths(self, texts: list[str]) -> np.ndarray:
        """[texts, languages]: code lengths in 1/UNIT bits."""
        n, out = int(self.symbol.max()) + 1, np.zeros((len(texts), len(self.languages)), np.int64)
        for a, b in slices(texts, 500_000):
            raw = [t.encode() for t in texts[a:b]]
            own = self.symbol[np.frombuffer(PAD + PAD.join(raw), np.uint8)].astype(np.int32)
            context = own[:-ORDER] * n**2 + own[1 : 1 - ORDER] * n + own[2 : 2 - ORDER]
            cell = self.state[context] * n + own[ORDER:]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            begin = np.cumsum(size + ORDER) - size - ORDER
            spans = np.stack([begin, begin + size], axis=1)[size > 0].ravel()
            if not len(spans):
                continue
            cell = cell[: spans[-1]]
            spans = spans[:-1]
            for k in range(len(self.languages)):
                out[a:b][size > 0, k] = np.add.reduceat(self.cost[k][cell], spans, dtype=np.int64)[::2]
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its share of the probability, bits per byte under it."""
        if not self.languages:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.lengths(texts) / UNIT
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        return best, share, least / np.maximum(1, np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ORDER + 1 bytes, the first of them contexts before the text, as numbers; counts."""
    found = []
    for a, b in slices(texts, 500_000):
        raw = [t.encode() for t in texts[a:b]]
        own = np.frombuffer(PAD + PAD.join(raw), np.uint8).astype(np.uint32)
        gram = own[:-3] << 24 | own[1:-2] << 16 | own[2:-1] << 8 | own[3:]
        inside = np.ones(len(gram), bool)
        at = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + ORDER)[:-1] - ORDER
        for k in range(ORDER):
            inside[at + k] = False
        found.append(np.unique(gram[inside], return_counts=True))
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return gram, np.bincount(back, np.concatenate([c for _, c in found]), len(gram)).astype(np.int64)


def build(languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray, cells: int = CELLS) -> Model:
    """The frozen model from counts of (language number, gram)."""
    gram = gram.astype(np.int64)
    digits = [(gram >> 8 * (ORDER - k)) & 255 for k in range(ORDER + 1)]
    seen = np.unique(np.concatenate([*digits, np.frombuffer(PAD, np.uint8)])).astype(np.int64)
    n = len(seen) + 1
    symbol = np.full(256, n - 1, np.int16)
    symbol[seen] = np.arange(len(seen))
    digits = [symbol[d].astype(np.int64) for d in digits]
    most = max(1, cells // (n * max(1, len(languages))))
    # contexts of each length by how often they occur in all languages; a context's suffix occurs as often at least
    orders = [np.zeros(1, np.int64)]
    total = 1
    for k in range(1, ORDER + 1):
        key = sum(digits[ORDER - j] * n ** (j - 1) for j in range(1, k + 1))
        own, back = np.unique(key, return_inverse=True)
        often = np.bincount(back, count, len(own))
        parent = np.isin(own % n ** (k - 1), orders[-1]) if k > 1 else np.ones(len(own), bool)
        rank = np.lexsort((own, -often))
        rank = rank[(often[rank] > 1) & parent[rank]][: max(0, most - total)]
        orders.append(np.sort(own[rank]))
        total += len(rank)
    base = np.cumsum([0, *map(len, orders)])
    state = np.zeros(n**ORDER, np.int32)
    grid = state.reshape((n,) * ORDER)
    for k in range(1, ORDER + 1):
        for number, context in enumerate(orders[k].tolist()):
            at = tuple(context // n ** (j - 1) % n for j in range(k, 0, -1))
            grid[(..., *at)] = base[k] + number
    cost = np.empty((len(languages), total * n), np.int32)
    for which in range(len(languages)):
        own = language == which
        shorter = np.full((1, n), 1 / 256)
        parents = [np.zeros(1, np.int64)]
        table = np.empty((total, n))
        for k in range(ORDER + 1):
            key = sum((digits[ORDER - j][own] * n ** (j - 1) for j in range(1, k + 1)), np.zeros(int(own.sum()), np.int64))
            at = np.searchsorted(orders[k], key)
            there = (at < len(orders[k])) & (orders[k][np.minimum(at, len(orders[k]) - 1)] == key) if len(orders[k]) else np.zeros(len(key), bool)
            number = np.zeros((len(orders[k]), n))
            np.add.at(number, (at[there], digits[ORDER][own][there]), count[own][there])
            up = shorter[np.zeros(1, np.int64) if k == 0 else np.searchsorted(parents[-1], orders[k] % n ** (k - 1))]
            total_n, q = number.sum(axis=1, keepdims=True), (number > 0).sum(axis=1, keepdims=True)
            unseen = np.where(number > 0, 0, up)
            # the last symbol stands for all bytes never seen, each with that share
            weight = np.ones(n)
            weight[-1] = 256 - (n - 1)
            mass = (unseen * weight).sum(axis=1, keepdims=True)
            p = np.where(number > 0, number / np.maximum(1, total_n + q), unseen * q / np.maximum(1, total_n + q) / np.maximum(mass, 1e-300))
            p = np.where(total_n > 0, p, up)
            table[base[k] : base[k + 1]] = p
            shorter, parents = p, [*parents, orders[k]]
        cost[which] = np.rint(-np.log2(np.maximum(table, 2.0**-60)) * UNIT).astype(np.int32).ravel()
    return Model(languages, symbol, state, cost)


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from rows (doc_id, text, ``label``) with neither text nor label null; the caller leaves out what is held out."""
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang")).filter("text is not null and lang is not null")
    unit = F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / (1 << 30)
    rows = rows.select("lang", "text", unit.alias("unit"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("unit").alias("least")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in found)
    if not languages:
        return Model([], np.zeros(256, np.int16), np.zeros(1, np.int32), np.zeros((0, 1), np.int32))
    wanted = min(sample, TOTAL / len(languages))
    share = F.create_map(*(x for r in found for x in (F.lit(r.lang), F.lit(max(r.least, wanted / r.n)))))[F.col("lang")]
    number = F.create_map(*(x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))))[F.col("lang")]
    chosen = rows.filter(F.col("unit") <= share).select(number.alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for k in np.unique(own).tolist():
                gram, n = _grams([t for t, x in zip(texts, own == k) if x])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(tidy(count), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return Model([], np.zeros(256, np.int16), np.zeros(1, np.int32), np.zeros((0, 1), np.int32))
    counts = counts.sort_by([("lang", "ascending"), ("gram", "ascending")])
    return build(languages, counts["lang"].to_numpy(), counts["gram"].to_numpy(), counts["n"].to_numpy())


RESULT = "struct<lang_pred:string,score:double,bits_per_byte:double>"


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column of ``RESULT`` for a text column."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        model = shared.value
        texts = [t or "" for t in column.to_pylist()]
        best, share, bits = model.predict(texts)
        names = [model.languages[k] if model.languages else "und" for k in best.tolist()]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share), pa.array(bits)], names=["lang_pred", "score", "bits_per_byte"])

    said = F.col(text).cast("string")
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    return F.when(F.coalesce(said, F.lit("")).rlike(r"\p{L}"), F.arrow_udf(tidy(run), RESULT)(F.coalesce(said, F.lit("")))).otherwise(none)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte: learned from the rows that aren't held out."""
    model = train(docs.filter(~held_out()), label, sample)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predicted(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits_per_byte")
