"""Near-duplicate documents by SimHash, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Where two fingerprints differ in at
most 4 bits, some two segments hold at most 2 of the differences between them.  The binary Golay code
of length 23 is perfect: every word is within 3 of one codeword.  The keys of a segment are the
indices of all codewords within 4 of it, which are 1 or 6; two segments that differ in at most 2 bits
share a key, since the word halfway lies within 3 of a codeword.  So keys of pairs of segments bring
all links together; each link is then verified on the fingerprints.

Rows are dealt by the index of one segment and as many leading bits of the other's as their number
asks for (``deal_bits``), and meet on the full keys within such a group: a fingerprint moves some 11
times instead of 85 as long as groups stay small.  The bits dealt by don't change what is found.  A
search that never looks at a row of a key again once it is linked gives a spanning forest, not all
pairs.  Groups with more rows than ``KEY_ROWS`` are dealt over pairs of blocks, so one task never
holds more than two blocks.  Copies meet first, as one row.

``keep_one`` asks for more: links are pairs whose sets of shingles have a Jaccard index of ``least``
or more.  Each set has ``PRINTS`` fingerprints.  The keys of all of them propose pairs, and those that
differ in no more than ``LOOSE`` of 256 bits make loose clusters.  Within a cluster all pairs are
decided on the whole sets, so fingerprints only propose.  Clusters of more than a block are decided
block by block, then among one document of each component found so far, and where that leaves more
than one component, over all pairs of blocks.

Defined results: null, empty or blank text has fingerprint 0 (an empty set) and is linked like any
other; a null doc_id is no component's name unless there is no other; repeated rows each get their
row (``keep_one`` keeps one of them); ties have the smallest doc_id; an empty table gives no rows; other
columns of the input are ignored (``keep_one`` hands them through, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, tidy, whole_row, written
from .graph import components

#: The generator polynomial of the binary Golay code, the cut of a fingerprint (shift, bits).
GENERATOR = 0b101011100011
SEGMENTS = [(0, 23), (23, 23), (46, 18)]
#: Rows of one group that a task searches at once, and those of a group that the bits dealt by aim at.
KEY_ROWS, GROUP_ROWS = 16_384, 1024
#: Differences that two segments may hold between them, and the distance that the keys cover so.
MOST_BITS = 4
SEED = 42


def shingles(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of a text in their order; a shorter text is one shingle, a blank one none."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: len(parts) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(begins.tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64, len(begins))


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text under XXH64."""
    hashes = shingles(text, width, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8"))[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        return pa.array(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    lean(docs.sparkSession)
    return docs.select("doc_id", F.arrow_udf(tidy(run), "long")("text").alias("fp"))


@lru_cache(1)
def patterns() -> np.ndarray:
    """[syndrome, 6]: the error words of weight up to 4 with this syndrome; -1 fills."""
    single = []
    for bit in range(23):
        rest = 1 << bit
        while rest >= 1 << 11:
            rest ^= GENERATOR << (rest.bit_length() - 12)
        single.append(rest)
    of: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = word = 0
            for b in bits:
                syndrome, word = syndrome ^ single[b], word | 1 << b
            of[syndrome].append(word)
    return np.array([x + [-1] * (6 - len(x)) for x in of], np.int32)


@lru_cache(1)
def syndromes() -> np.ndarray:
    """Syndrome of every 23-bit word."""
    out = np.zeros(1 << 23, np.int16)
    for bit in range(23):
        rest = 1 << bit
        while rest >= 1 << 11:
            rest ^= GENERATOR << (rest.bit_length() - 12)
        out[1 << bit : 2 << bit] = out[: 1 << bit] ^ rest
    return out


def segment_keys(words: np.ndarray) -> np.ndarray:
    """[n, 6]: indices of the codewords within 4 of each 23-bit word; -1 fills."""
    errors = patterns()[syndromes()[words]]
    return np.where(errors >= 0, (words[:, None].astype(np.int32) ^ errors) >> 11, -1)


#: Bits of a key's second half: which segment, and the index of its codeword.
HALF = 13


def halves(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For keys that begin in segment 0 and in segment 1: [n, 6] first halves, and [n, 12] second halves; -1 fills."""
    own = [segment_keys(((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in SEGMENTS]
    last = np.where(own[2] >= 0, own[2] | 1 << HALF - 1, -1)
    return own[:2], [np.concatenate([own[1], last], axis=1), np.concatenate([np.full_like(last, -1), last], axis=1)]


def deal_bits(rows: int) -> int:
    """Bits of the second half that rows are dealt by, so that groups of ``rows`` fingerprints have about ``GROUP_ROWS``."""
    # 5.4 first halves a fingerprint, among 4096, and 10.7 second halves, which share leading bits at first
    return next((bits for bits in range(HALF) if rows * 5.4 * min(2**bits, 10.7) <= GROUP_ROWS * 4096 * 2**bits), HALF)


def group_keys(prints: np.ndarray, bits: int, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint of each) of the groups that fingerprint ``number`` of a row is dealt to."""
    keys, rows = [], []
    for begin, (first, second) in enumerate(zip(*halves(prints))):
        lead = np.sort(np.where(second >= 0, second >> HALF - bits, -1), axis=1)
        lead[:, 1:][lead[:, 1:] == lead[:, :-1]] = -1
        both = (first[:, :, None] << bits) | lead[:, None, :]
        there = (first[:, :, None] >= 0) & (lead[:, None, :] >= 0)
        keys.append(both[there] | (number << 1 | begin) << 12 + bits)
        rows.append(np.nonzero(there)[0])
    return np.concatenate(keys).astype(np.int32), np.concatenate(rows)


def full_keys(key: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(full keys within its group, index) of rows (group key, fingerprint)."""
    second = np.where((key >> 12 + bits & 1)[:, None] == 0, *halves(prints)[1])
    at, row = (second >= 0) & (second >> HALF - bits == (key & (1 << bits) - 1)[:, None]), np.arange(len(key))
    return ((key.astype(np.int64) << HALF)[:, None] | second)[at], np.repeat(row, at.sum(axis=1))


def apart(prints: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints."""
    return np.bitwise_count(prints ^ other).sum(axis=-1, dtype=np.int32)


def forest(prints: np.ndarray, bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of a spanning forest of the links among ``prints`` (rows of uint64)."""
    left, right, rest = [], [], np.arange(len(prints))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            p = front.pop()
            near = apart(prints[rest], prints[p]) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), p))
                right.append(found)
                front.extend(found)
    nothing = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (nothing, nothing)


SMALL = 6


def _links(key: np.ndarray, row: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows) within the runs of equal keys (sorted): neighbours of short runs at once, long runs one by one."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    short = np.repeat(size <= SMALL, size)
    left, right = [row[:0]], [row[:0]]
    for step in range(1, SMALL):
        same = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
        a, b = row[same], row[same + step]
        near = apart(prints[a], prints[b]) <= bits
        left.append(a[near])
        right.append(b[near])
    for k in np.flatnonzero(size > SMALL):
        run = row[starts[k] : starts[k] + size[k]]
        a, b = forest(prints[run], bits)
        left.append(run[a])
        right.append(run[b])
    return np.concatenate(left), np.concatenate(right)


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[n, 2]: the components of the edges (a, b) again, each as edges from its least node to the others."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (a, b):  # the least neighbour becomes the root of the old root too
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[other]], nodes[other]], axis=1)


class Search:
    """Links of rows (key, id, fingerprints, that of the key first) sorted by key and id.

    A result row is an edge, its key null, or a row of a group with too many rows, with its key and a null other end.
    """

    def __init__(self, prints: int, most: int, bits: int):
        self.n, self.most, self.bits = prints, most, bits
        own = [f"f{k}" for k in range(prints)]
        self.own = ["id", *own]
        self.schema = pa.schema([("key", pa.int32()), ("id", pa.int64()), ("b", pa.int64()), *((x, pa.int64()) for x in own)])
        self.ddl = "key int, id long, b long, " + ", ".join(f"{x} long" for x in own)

    def edges(self, key: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        ids, prints = rows[:, 0], rows[:, 1:].view(np.uint64)
        full, row = full_keys(key, prints[:, 0], self.bits)
        order = np.argsort(full, kind="stable")
        both = stars(*(ids[x] for x in _links(full[order], row[order], prints, self.most)))
        rest = [pa.nulls(len(both), pa.int64())] * self.n
        return pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), *rest], schema=self.schema)

    def hand_on(self, key: int, rows: np.ndarray) -> pa.RecordBatch:
        own = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(self.n + 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key, np.int32)), own[0], pa.nulls(len(rows), pa.int64()), *own[1:]], schema=self.schema)

    def complete(self, key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))
        if size.max() > KEY_ROWS:
            many = np.repeat(size > KEY_ROWS, size)
            for k in np.unique(key[many]):
                yield self.hand_on(int(k), rows[key == k])
            key, rows = key[~many], rows[~many]
        if len(key):
            yield self.edges(key, rows)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int32), np.zeros((0, self.n + 1), np.int64)
        over = None  # the key whose rows are handed on
        for batch in batches:
            held_key = np.concatenate([held_key, batch.column(0).to_numpy()])
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)])
            if over is not None:
                n = int(np.searchsorted(held_key, over, "right"))
                if n:
                    yield self.hand_on(over, held[:n])
                held_key, held = held_key[n:], held[n:]
                if not len(held):
                    continue
                over = None
            if not len(held):
                continue
            last = int(np.searchsorted(held_key, held_key[-1], "left"))
            if last:
                yield from self.complete(held_key[:last], held[:last])
                held_key, held = held_key[last:], held[last:]
            if len(held) > KEY_ROWS:
                over = int(held_key[0])
                yield self.hand_on(over, held)
                held_key, held = held_key[:0], held[:0]
        if len(held):
            yield from self.complete(held_key, held)

    def block(self, group: pa.Table) -> pa.Table:
        rows = np.stack([group.column(x).to_numpy() for x in self.own], axis=1)
        order = np.argsort(rows[:, 0], kind="stable")
        return pa.Table.from_batches([self.edges(group.column("key").to_numpy()[order], rows[order])])


def _blocks(crowded: DataFrame, search: Search) -> DataFrame:
    """Links of the groups with many rows: every two blocks of a group meet."""
    count = written(crowded.groupBy("key").count())
    n = F.ceil(F.col("count") / (KEY_ROWS // 2)).cast("int")
    dealt = crowded.join(count, "key").select("key", *search.own, n.alias("n"), F.pmod(F.xxhash64("id"), n).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    meet = dealt.select("key", *search.own, "mine", other).select("key", *search.own, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    return meet.groupBy("key", "x", "y").applyInArrow(search.block, search.ddl)


def links(rows: DataFrame, number: int, prints: int = 1, most: int = MOST_BITS, checked: int = 1) -> DataFrame:
    """Edges (a, b) between ids of ``number`` rows (id, fp0, fp1, ...); their components are those of all links found.

    Rows meet on the keys of each of their ``prints`` fingerprints; a link is up to ``most`` differences in
    that one and those after it, ``checked`` in all.
    """
    bits = deal_bits(number)
    search = Search(checked, most, bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), [c.to_numpy() for c in batch.columns[1:]]
            for a in range(0, len(ids), 4096):
                for k in range(prints):
                    key, row = group_keys(own[k][a : a + 4096].view(np.uint64), bits, k)
                    row += a
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), *(pa.array(own[(k + j) % prints][row]) for j in range(checked))], names=["key", "id", *(f"f{j}" for j in range(checked))])

    schema = ", ".join(["key int", "id long", *(f"f{j} long" for j in range(checked))])
    by_key = rows.select("id", *(f"fp{k}" for k in range(prints))).mapInArrow(tidy(keys), schema).repartition("key").sortWithinPartitions("key", "id")
    # a row is dealt to some 11 groups by each fingerprint and compared there; its links are few
    found = written(by_key.mapInArrow(tidy(search.run), search.ddl), number * prints)
    edges = found.filter("key is null").select(F.col("id").alias("a"), "b")
    crowded = found.filter("key is not null")
    if not crowded.isEmpty():
        edges = edges.unionByName(_blocks(crowded, search).select(F.col("id").alias("a"), "b"))
    edges.written_to = found.written_to
    return edges


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``rows`` (doc_id, fp)."""
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), rows.count())
    number = least.count()
    # Nodes sort by smallest doc_id; a fingerprint without any comes last.
    node = F.struct(F.coalesce("low", F.lit(2**63 - 1)).alias("low"), "fp")
    edges = found = links(least.select(F.col("fp").alias("id"), F.col("fp").alias("fp0")), number)
    for end in ("a", "b"):
        edges = edges.withColumnRenamed(end, "fp").join(least.select("fp", node.alias(end)), "fp").drop("fp")
    label = components(edges.select("a", "b"), number)
    root = label.select("node.fp", F.col("root.low").alias("root"))
    out = written(least.join(root, "fp", "left").select("fp", F.coalesce(F.when(F.col("root") < 2**63 - 1, F.col("root")), "low").alias("component_id")), number)
    discard(label, found, least)
    return out


def simhash_components(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one fingerprint, up to 4 bits, all links."""
    rows = written(fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width))
    return rows.join(near_duplicates(rows), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a set; how many of them a candidate is checked by; the bits of these that it may differ in.  Sets with an
#: index of 0.8 differ in about 39 of 256, at most 48 (4 of 5 shingles), with a deviation of 6; unrelated ones in 128.
PRINTS, CHECKED, LOOSE = 8, 4, 76
#: Shingles and documents of one block of a cluster.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 20, 256
#: Keeps bounds that are computed in doubles on the safe side.
SLACK = 1e-9


def mixed_bits(hashes: np.ndarray, number: int) -> np.ndarray:
    """``number`` fingerprints of a set of hashes, each over other bits mixed from them (SplitMix64)."""
    ones = np.zeros(64 * number, np.int64)
    start = np.arange(1, number + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(hashes), 8192):
        z = hashes[a : a + 8192, None] + start
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """doc, w0, w1, and of the set of shingles of text: h0 and h1 (its hash), n (its size), fp0, fp1, ..."""

    def run(column: pa.Array) -> pa.Array:
        import xxhash

        sets = [np.unique(shingles(t, width)) for t in column.to_pylist()]
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        prints = np.array([mixed_bits(s, PRINTS) for s in sets], np.int64).reshape(-1, PRINTS)
        columns = [digest[:, 0], digest[:, 1], np.array([len(s) for s in sets], np.int64), *prints.T]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["h0", "h1", "n", *(f"fp{k}" for k in range(PRINTS))])

    kind = f"struct<h0:long, h1:long, n:long, {', '.join(f'fp{k}:long' for k in range(PRINTS))}>"
    return texts.select("doc", "w0", "w1", F.arrow_udf(tidy(run), kind)("text").alias("s")).select("doc", "w0", "w1", "s.*")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``texts`` with the sets of shingles in place of the column text."""

    def run(column: pa.Array) -> pa.Array:
        sets = [np.unique(shingles(t, width)) for t in column.to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))

    return texts.withColumn("shingles", F.arrow_udf(tidy(run), "array<long>")("text")).drop("text")


def agreeing(shingle: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs of sets (one after another) whose Jaccard index is ``least`` or more.

    Common shingles are counted pair by pair where few sets hold them, and by a matrix product where many do.
    """
    n, few = len(sizes), 32
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(shingle)))
    common = np.zeros(n * n, np.float32)
    column, of = np.repeat(np.arange(len(held)), held), np.repeat(held, held)
    rare = (of > 1) & (of <= few)
    a, c = owner[rare], column[rare]
    for step in range(1, int(of[rare].max(initial=1))):
        same = c[step:] == c[:-step]
        if n <= 64:
            common += np.bincount(a[:-step][same] * n + a[step:][same], minlength=n * n)
        else:
            np.add.at(common, a[:-step][same] * n + a[step:][same], np.float32(1))
    common = common.reshape(n, n)
    common = common + common.T
    a, c = owner[of > few], np.unique(column[of > few], return_inverse=True)[1]
    width = max(1, (1 << 22) // max(1, n))
    for begin in range(0, int(c.max(initial=-1)) + 1, width):
        here = (c >= begin) & (c < begin + width)
        matrix = np.zeros((n, width), np.float32)
        matrix[a[here], c[here] - begin] = 1
        common += matrix @ matrix.T
    near = common >= least * (sizes[:, None] + sizes[None, :] - common) - SLACK
    left, right, rest = [], [], np.ones(n, bool)
    for root in range(n):
        front = [root] if rest[root] else []
        rest[root] = False
        while front:
            p = front.pop()
            found = np.flatnonzero(near[p] & rest)
            rest[found] = False
            left.extend([p] * len(found))
            right.extend(found)
            front.extend(found)
    return np.array(left, np.int64), np.array(right, np.int64)


def decided(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of the pairs that agree among the ``rows`` (cluster, x, y, id, shingles) of each (cluster, x, y)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
            table = pa.Table.from_batches([batch])
            if held and any(held[-1].column(k)[-1].as_py() != own[0, k] for k in range(3)):
                yield pa.concat_tables(held)
                held = []
            for begin, end in zip([0, *cuts], [*cuts, None]):
                held.append(table.slice(begin, None if end is None else end - begin))
                if end is not None:
                    yield pa.concat_tables(held)
                    held = []
        if held:
            yield pa.concat_tables(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            if group.num_rows < 2:
                continue
            ids, lists = group.column("id").to_numpy(), group.column("shingles").combine_chunks()
            a, b = agreeing(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    lean(rows.sparkSession)
    met = rows.select("cluster", "x", "y", "id", "shingles").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return written(met.mapInArrow(tidy(run), "a long, b long"))


def agreed(members: DataFrame, texts: DataFrame, width: int, least: float, repeated: bool) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs that agree within a cluster; ``members`` has cluster, id, n, w0, w1."""
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"))
    number = members.count()
    large = written(size.filter("blocks > 1"), number)
    mine = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(0).cast("int")
    dealt = members.join(large, "cluster", "left").select("w0", "w1", "cluster", "id", "blocks", mine.alias("x"), mine.alias("y"))
    found = texts.select("w0", "w1", "text").join(dealt, ["w0", "w1"])
    if repeated:
        found = found.dropDuplicates(["id"])
    sets = shingle_sets(found, width)
    if large.isEmpty():
        edges = decided(sets, least)
        discard(large)
        return edges
    whole = written(sets)
    edges = decided(whole, least)
    sets = whole.filter("blocks > 1")
    for last in (False, True):
        label = components(edges, number)
        now = written(sets.select("cluster", "id", "blocks", "x").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
        discard(label)
        firsts = now.groupBy("cluster", "root").agg(F.first("blocks").alias("blocks"))
        apart = firsts.groupBy("cluster").agg(F.count("*").alias("parts"), F.first("blocks").alias("blocks")).filter("parts > 1")
        if apart.isEmpty():
            discard(now)
            break
        if last:  # all pairs of blocks
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            meet = now.join(apart.select("cluster"), "cluster", "left_semi").select("id", "cluster", "x", other.alias("other")).select("id", "cluster", F.least("x", "other").alias("x"), F.greatest("x", "other").alias("y"))
        else:  # one document of each component, in no more blocks than these need
            few = apart.select("cluster", F.least("blocks", F.ceil(F.col("parts") / BLOCK_DOCS)).cast("int").alias("few"))
            block = F.pmod(F.xxhash64("id"), F.col("few")).cast("int")
            meet = firsts.select("cluster", F.col("root").alias("id")).join(few, "cluster").select("id", "cluster", block.alias("x"), block.alias("y"))
        more = decided(meet.join(sets.select("id", "shingles"), "id"), least)
        before, edges = edges, written(edges.unionByName(more))
        discard(more, now, before)
    discard(large, whole)
    return edges


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, without those that have a near-duplicate with a smaller doc_id; of equal doc_ids one row stays.

    Near-duplicates are linked by sets of ``width``-word shingles with a Jaccard index of ``least`` or more, over
    any number of links.  A row is known by two hashes of all its columns, so equal rows are one.
    """
    lean(docs.sparkSession)
    plain = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    own = [whole_row(docs).alias("row"), F.xxhash64(*plain).alias("w0"), F.xxhash64(F.lit("other"), *plain).alias("w1")]
    marked = docs.select(*own)
    texts = marked.select(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), "w0", "w1", F.col("row.text").cast("string").alias("text"))
    rows = written(sketches(texts, width))
    number = rows.count()
    repeated = written(rows.groupBy("w0", "w1").count().filter("count > 1").select("w0", "w1"), number)
    again = not repeated.isEmpty()
    values = [F.first(c).alias(c) for c in ("n", *(f"fp{k}" for k in range(PRINTS)))]
    firsts = written(rows.groupBy("h0", "h1").agg(F.min(F.struct("doc", "w0", "w1")).alias("low"), *values).drop("h0", "h1").withColumn("id", F.monotonically_increasing_id()), number)
    number = firsts.count()
    near = links(firsts, number, PRINTS, LOOSE, CHECKED)
    loose = components(near, number)
    cluster = loose.select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    members = written(firsts.select("id", "n", "low.w0", "low.w1").join(cluster, "id"), number)
    discard(rows, near, loose)
    found = agreed(members, texts, width, least, again)
    label = components(found, number)
    root = label.select(F.col("node").alias("id"), "root")
    groups = firsts.select("id", "low").join(root, "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min("low").alias("low"))
    stays = written(groups.select("low.w0", "low.w1"), number)
    discard(members, found, label, firsts)
    kept = marked.join(stays, ["w0", "w1"], "left_semi")
    if again:
        once = kept.join(repeated, ["w0", "w1"], "left_semi").dropDuplicates(["w0", "w1"])
        kept = kept.join(repeated, ["w0", "w1"], "left_anti").unionByName(once)
    return kept.select("row.*")
