"""Token counts of a sentencepiece BPE model at every prefix of a text.

For BPE the encoding of a prefix ends in exactly one token that follows its predecessor validly: the
one vocabulary suffix ``t`` of the prefix for which (last token before ``t``, ``t``) encode together
to themselves.  So one pass over the characters gives the token count of every prefix.  Blanks and
line ends bound what can merge, hence a text's counts are those of its words, summed: a batch of texts is cut
at once, and each distinct word is solved once and remembered.  Whether two tokens stay apart is asked of the library and remembered.

Defined results: a null text is empty and has 0 tokens; equal rows and doc_ids are counted row by
row; other columns of the input are ignored; an empty table gives no rows.  Text is taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, tidy

MARK = "▁"
#: What a normalising model would rewrite: wide and joined letters, marks after letters, signs, two blanks, line ends, tabs.
PROBE = "Ａ ﬁ e\u0301 ① ½ \u00a0x  y\tz\nÅ ．"
RUN = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters from which a text is cut alone.
LONG = 50_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fits_chars", pa.int64())])


class Words(dict):
    """Word -> token counts of its prefixes, of length 0, 1, ...; a word opens with a blank, or after "\\n" without one."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, word: str) -> tuple[int, ...]:
        k, pairs = len(word), self.counter.pairs
        while k > 1 and word[k - 2 : k] not in pairs:
            k -= 1
        if 0 < k < len(word):
            # no piece holds two characters in a row from here on, so each stands alone
            new, counts = word[:k] not in self, list(self[word[:k]])
            for c in word[k:]:
                counts.append(counts[-1] + (1 if c in self.counter.piece else len(c.encode())))
            found = tuple(counts)
            if new:
                return found
        elif word[:1] == "\n":
            found = (0, *(1 + n for n in self.counter.solve(word[1:])))
        else:
            found = self.counter.solve(MARK + word)
        if len(word) <= 64:
            self[word] = found
        return found


class PrefixCounter:
    """Counts of one model.  Holds for models whose blanks are marks, with a blank put before the text and no other normalisation."""

    def __init__(self, file: str, memo: int = 400_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        lib = self.library
        if (got := lib.normalize(PROBE)) != MARK + PROBE.replace(" ", MARK):
            raise ValueError(f"the model rewrites text before it encodes: {got!r}")
        normal = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {lib.id_to_piece(i) for i in normal}
        self.backwards: dict = {}  # the pieces from their ends: character -> the same before it, "" -> the piece
        for p in self.piece:
            node = self.backwards
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.piece):
            raise ValueError("the vocabulary has pieces that cross words")
        self.pairs = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.memo, self.apart, self.words = memo, {}, Words(self)

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the text ``a + b`` is encoded as the tokens a, b."""
        if (known := self.apart.get((a, b))) is None:
            got = self.library.encode(a[1:] + b if a[0] == MARK else "\n" + a + b, out_type=str)
            known = self.apart[a, b] = (got if a[0] == MARK else got[2:]) == [a, b]
        return known

    def solve(self, s: str) -> tuple[int, ...]:
        """Token counts of every prefix of ``s`` (no text between a blank and the next but this)."""
        count, last, apart, backwards = [0], [None], self.apart, self.backwards
        for j in range(1, len(s) + 1):
            node, i = backwards, j
            while i:
                i -= 1
                if (node := node.get(s[i])) is None:
                    i = -1
                    break
                if (t := node.get("")) is not None:
                    if (before := last[i]) is None:
                        break
                    if (ok := apart.get((before, t))) is None:
                        ok = self.stay_apart(before, t)
                    if ok:
                        break
            else:
                i = -1
            if i < 0:  # not in the vocabulary: a token for each byte
                count.append(count[-1] + len(s[j - 1].encode()))
                last.append(None)
            else:
                count.append(count[i] + 1)
                last.append(t)
        return tuple(count)

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """Prefix counts of the runs of a text that can't merge with one another; with the blank before the text."""
        if len(self.words) > self.memo or len(self.apart) > 4 * self.memo:
            self.words.clear()
            self.apart.clear()
        if not text:
            return []
        if not self.plain(text):
            return [self.solve(run) for run in RUN.findall(MARK + text.replace(" ", MARK))]
        return list(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))

    def plain(self, text: str) -> bool:
        """Whether single blanks and line ends part the words of a text."""
        return not ("  " in text or MARK in text or " \n" in text or text[0] in " \n")

    def totals(self, texts: list[str], limit: int) -> tuple[np.ndarray, list[int]]:
        """Token counts of texts, and how many characters of each the limit leaves."""
        out, fits = np.zeros(len(texts), np.int64), list(map(len, texts))
        together = [i for i, t in enumerate(texts) if t and len(t) < LONG and self.plain(t)]
        for i in set(range(len(texts))).difference(together):
            parts = self.parts(texts[i])
            out[i] = sum(map(itemgetter(-1), parts))
            if out[i] > limit:
                fits[i] = self.fits(parts, limit)
        if not together:
            return out, fits
        if len(self.words) > self.memo or len(self.apart) > 4 * self.memo:
            self.words.clear()
            self.apart.clear()
        cut = pc.split_pattern(pc.replace_substring(pa.array([texts[i] for i in together], pa.string()), "\n", " \n"), " ")
        words = cut.flatten().dictionary_encode()
        known = [self.words[w] for w in words.dictionary.to_pylist()]
        index, starts = words.indices.to_numpy(), cut.offsets.to_numpy()
        size = np.fromiter(map(itemgetter(-1), known), np.int64, len(known))[index]
        out[together] = np.add.reduceat(size, starts[:-1])
        for i, a, b in zip(together, starts[:-1].tolist(), starts[1:].tolist()):
            if out[i] > limit:
                # the last word that begins within the limit: a prefix of it fits, or its beginning does
                last = int(np.searchsorted(np.cumsum(size[a:b]) - size[a:b], limit, "right"))
                parts = [known[k] for k in index[a : a + last].tolist()]
                fits[i] = self.fits(parts, limit)
        return out, fits

    def count(self, text: str) -> int:
        return sum(map(itemgetter(-1), self.parts(text)))

    def every_prefix(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ..., text."""
        out, base = [0], 0
        for part in self.parts(text):
            out += [base + n for n in part[1:]]
            base += part[-1]
        # the blank before the text is no prefix of its own
        return [0, *out[2:]] if text else [0]

    def fits(self, parts: list[tuple[int, ...]], limit: int) -> int:
        """Length in characters of the longest prefix of no more than ``limit`` tokens, from the stored counts."""
        base, at, most = 0, 0, 0
        for part in parts:
            if base > limit:
                break
            for k in range(len(part) - 1, 0, -1):
                if base + part[k] <= limit:
                    most = at + k
                    break
            base, at = base + part[-1], at + len(part) - 1
        return max(0, most - 1)


@lru_cache(2)
def shared_counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fits_chars: how much of the text the limit would leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens, fits = counter.totals(texts, limit)
            n_bytes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            columns = [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)
