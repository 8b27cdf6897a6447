"""Exact ids of a byte-level BPE ``tokenizers`` file, at memo speed.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, so the ids of a text are
the ids of its pieces, joined.  ``ByteBpe`` cuts a whole batch of texts at once with numpy, works out the
ids of each *distinct* piece it has not seen, and gathers the rest.  New pieces are merged together by the
vocabulary's ranks; long ones go to the ``tokenizers`` library.

Texts that hold a special string of the vocabulary, or a code point whose class the library and the
local Unicode tables could see differently, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER, END, UNSURE = 1, 2, 3, 0, 4, 5

#: The white space of the pre-tokenizer's pattern (Unicode White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Stands between pieces; no UTF-8 text has this byte.
BETWEEN = 0xFF


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point; what is unassigned here may be assigned in the library's tables."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
        elif kind in ("Cn", "Cs"):
            table[cp] = UNSURE
        elif cp >= 0x1C80 and _young(cp):
            table[cp] = UNSURE
    table[WHITE_SPACE] = SPACE
    return table


def _young(cp: int) -> bool:
    """Unknown to the Unicode 3.2 tables that Python also carries: ages of such code points vary between libraries."""
    return unicodedata.ucd_3_2_0.category(chr(cp)) == "Cn"


def cut(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokenizer's pieces over the joined texts; see ``ByteBpe.encode``.

    Returns (offsets of n + 1 piece bounds, the joined UTF-8, index of each text's end mark among
    the pieces, texts with a code point of unsure class).
    """
    joined = "\0".join(texts) + "\0"
    raw = joined.encode("utf-8")
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = _classes()[chars]
    unsure = np.flatnonzero(kind == UNSURE)
    kind[ends] = END
    n = len(kind)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends] = True
    after = ends[:-1] + 1
    start[after] = True
    # The last white space before a word stands alone, or, if it is a blank, opens the word.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    start[last] = True
    blank = last[chars[last] == 0x20]
    start[blank + 1] = False
    # 's 't 'm 'd 're 've 'll open where the quote is not the tail of a run of other signs or of a blank.
    quote = np.flatnonzero((chars[:-1] == 0x27) & (kind[1:] == LETTER))
    if len(quote):
        before = np.where(quote > 0, quote - 1, 0)
        free = (quote == 0) | ((kind[before] != OTHER) & (kind[before] != UNSURE) & (chars[before] != 0x20)) | (kind[before] == END)
        quote = quote[free]
        one, two = chars[quote + 1], chars[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, width in ((quote[short], 2), (quote[long & ~short], 3)):
            start[found + 1] = False
            start[found + width] = True
    bounds = np.flatnonzero(start)
    marks = np.searchsorted(bounds, ends)
    if len(raw) != n:
        wide = np.ones(n, np.int8)
        wide += chars >= 0x80
        wide += chars >= 0x800
        wide += chars >= 0x10000
        at = np.zeros(n + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        bounds = at[bounds]
    bad = np.unique(np.searchsorted(ends, unsure)) if len(unsure) else unsure
    return np.append(bounds, len(raw)).astype(np.int32), raw, marks, bad


#: Characters of a very long text that are encoded at once.
LONG = 1_000_000


def parts_of(text: str) -> list[str]:
    """Cuts a very long text before blanks at which the pre-tokenizer always cuts."""
    parts, a = [], 0
    while len(text) - a > LONG and (m := SAFE.search(text, a + LONG)):
        parts.append(text[a : m.start() + 1])
        a = m.start() + 1
    return [*parts, text[a:]]


#: A letter, then (cut here) a blank, then a letter.
SAFE = re.compile("[A-Za-z](?= [A-Za-z])")


NEVER = np.iinfo(np.int32).max
#: Bytes of the longest piece that is merged together with others.
SHORT = 40


class Merges:
    """The merges of a byte-level model, applied to many short pieces at once: in each round every piece merges its first
    pair of the least rank, as one piece alone would."""

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte = np.array([vocab[BYTE_LETTERS[b]] for b in range(256)], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        # a table of pairs by hash; a taken place sends to the next one
        self.bits = max(10, len(key).bit_length() + 3)
        self.key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.rank = np.full(len(self.key), NEVER, np.int32)
        at, waits = self._slot(key), np.arange(len(key))
        while len(waits):
            free = waits[self.key[at[waits]] == -1]
            self.key[at[free]] = key[free]
            done = self.key[at[waits]] == key[waits]
            self.rank[at[waits[done]]] = waits[done]
            waits = waits[~done]
            at[waits] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NEVER`` for what is no merge, or where b is -1."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        there = self.key.take(at)
        out = np.where(there == key, self.rank.take(at), NEVER)
        on = np.flatnonzero((there != key) & (there != -1) & (b >= 0))
        while len(on):
            at[on] += 1
            there = self.key.take(at.take(on))
            hit = there == key.take(on)
            out[on[hit]] = self.rank.take(at[on[hit]])
            on = on[~hit & (there != -1)]
        out[b < 0] = NEVER
        return out

    def apply(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces, a row each; their number) of pieces data[begin : begin + size], all of nearly one size."""
        width = int(size.max()) + 1
        place = np.arange(width)
        held = place < size[:, None]
        ids = np.where(held, self.byte.take(data.take(np.where(held, begin[:, None] + place, 0))), -1)
        rank = np.full(ids.shape, NEVER, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        out, size = np.full(ids.shape, -1, np.int32), size.copy()
        rows = np.arange(len(ids))
        while len(rows):
            at = rank.argmin(axis=1)
            here = np.arange(len(rows))
            least = rank[here, at]
            open_ = least < NEVER
            if not open_.all():
                out[rows[~open_]] = ids[~open_]
                rows, ids, rank, at, least = rows[open_], ids[open_], rank[open_], at[open_], least[open_]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            moved = np.minimum(place + (place > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, moved, axis=1), np.take_along_axis(rank, moved, axis=1)
            ids[here, at] = self.made.take(least)
            size[rows] -= 1
            after = ids[here, np.minimum(at + 1, width - 1)]
            rank[here, at] = self.ranks(ids[here, at], after)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
        return out, size

    def pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all short pieces, joined; number for each)."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        size = np.diff(bounds)
        order = np.argsort(size, kind="stable")
        count, at, found = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), []
        total = 0
        for a in range(0, len(order), 8192):
            part = order[a : a + 8192]
            ids, n = self.apply(data, bounds[part], size[part])
            found.append(ids[ids >= 0])
            count[part], at[part] = n, total + np.cumsum(n) - n
            total += int(n.sum())
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        to = np.cumsum(count) - count
        return ids[np.repeat(at - to, count) + np.arange(total)].astype(np.uint32), count


class ByteBpe:
    """Encodes lists of texts; beyond ``memo`` distinct pieces those that were met once are forgotten."""

    def __init__(self, file: str, memo: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the same model over pieces that are cut already, one a line
        self.by_line = Tokenizer(self.library.model)
        self.by_line.pre_tokenizer = CharDelimiterSplit("\n")
        self.merges = Merges(json.loads(self.library.to_str())["model"])
        self.letters = {**BYTE_LETTERS, BETWEEN: "\n"}
        self.memo = memo
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that were met again; none if most were."""
        kept = np.flatnonzero(self.uses > 1)
        if 2 * len(kept) > self.memo:
            return self._clear()
        size = np.diff(self.at)[kept]
        to = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.at[kept] - to, size) + np.arange(size.sum())]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.known, self.uses = self.known.take(pa.array(kept)), np.ones(len(kept), np.int64)

    def _learn(self, pieces: pa.StringArray) -> np.ndarray:
        """Learns the ids of pieces and returns the order that they are known in: short ones from the model's merges, others
        from the library's model, where a byte stands for itself as a letter."""
        pieces = pa.concat_arrays([pieces])
        short = pc.less_equal(pc.binary_length(pieces), SHORT)
        order = np.concatenate([np.flatnonzero(short.to_numpy(zero_copy_only=False)), np.flatnonzero(~short.to_numpy(zero_copy_only=False))])
        pieces, few = pieces.take(pa.array(order)), int(pc.sum(short).as_py() or 0)
        ids, count = self.merges.pieces(pieces[:few])
        found, counts = [ids], [count]
        for a in range(few, len(pieces), 8192):
            part = pieces[a : a + 8192]
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.cast(pa.binary())), bytes([BETWEEN]))[0].as_py()
            lib = self.by_line.encode(lines.decode("latin1").translate(self.letters), add_special_tokens=False)
            counts.append(np.bincount(np.array(lib.word_ids, np.int64), minlength=len(part)))
            found.append(np.array(lib.ids, np.uint32))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(counts))])
        self.flat = np.concatenate([self.flat, *found])
        self.known = pa.concat_arrays([self.known, pieces])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])
        return order

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, joined, as uint32; bounds of each text's ids, one more than texts)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(texts) == 1 and len(texts[0]) > 2 * LONG and not any(s in texts[0] for s in self.special):
            ids = np.concatenate([self.encode([part])[0] for part in parts_of(texts[0])])
            return ids, np.array([0, len(ids)])
        if len(self.known) > self.memo:
            self._forget()
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        bounds, raw, marks, bad = cut(["" if i in whole else t for i, t in enumerate(texts)])
        whole.update(bad.tolist())
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        of_word = pc.index_in(pieces.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(of_word < 0)
        if len(new):
            base = len(self.known)
            of_word[new[self._learn(pieces.dictionary.take(pa.array(new)))]] = base + np.arange(len(new))
        self.uses[of_word] += 1
        piece = of_word[pieces.indices.to_numpy()]
        size = self.at[piece + 1] - self.at[piece]
        size[marks] = 0
        to = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        ids = self.flat[np.repeat(self.at[piece] - to[:-1], size) + np.arange(to[-1])]
        ends = np.concatenate([[0], to[marks]])
        if whole:
            parts = [np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, ends


@lru_cache(2)
def shared_encoder(file: str) -> ByteBpe:
    """One encoder for each worker process, kept between tasks."""
    return ByteBpe(file)
