"""Encoding, packing, token counts and shards, against the libraries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, repair, tokencount
from tessella.llm.bytebpe import ByteBpe
from tessella.llm.queries import BYTES, PIECES

LIBRARY, MODEL = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
ENCODER, COUNTER = ByteBpe(BYTES), tokencount.PrefixCounter(PIECES)
BITS = st.lists(st.sampled_from(["'", "s", "re", "ll", "ve", "d", " ", "  ", "\n", "\t", " ", "a", "é", "1", "²", "!", "-", "<|endoftext|>", "日", "　", "\r\n", "\0", "'t", "'M", "the", "ing", "▁", "<s>", "😀", "\U000107ff"]), max_size=14).map("".join)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(BITS, max_size=5))
def test_ids_are_the_library_s(texts):
    ids, ends = ENCODER.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]


def test_ids_of_every_code_point_and_of_very_long_texts():
    points = [f"a{chr(c)}a1{chr(c)} {chr(c)}" for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    ids, ends = ENCODER.encode(points)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in points]
    long = "some words, 42 of them!\n" * 100_000
    assert ENCODER.encode([long])[0].tolist() == ids_of(long)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeinorst éüß日0123456789"), max_size=120), max_size=40))
def test_merged_pieces_are_the_library_s(texts):
    ids, ends = ENCODER.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]


def test_pieces_may_be_forgotten():
    encoder = ByteBpe(BYTES, memo=30)
    for k in range(40):
        texts = [f"the same words, and {chr(97 + k % 26) * (k + 3)} n{k}", "the same words"]
        ids, ends = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]
    assert len(encoder.known) < 60


@settings(max_examples=100, deadline=None)
@given(BITS, st.integers(0, 6))
def test_counts_of_every_prefix(text, limit):
    want = [len(x) for x in MODEL.encode([text[:i] for i in range(len(text) + 1)])]
    assert COUNTER.every_prefix(text) == want
    longest = max(i for i, n in enumerate(want) if n <= limit)
    assert COUNTER.fits(COUNTER.parts(text), limit) == longest
    n_tokens, fits = COUNTER.totals([text, "", text + " word", "some words\nin lines"], limit)
    assert n_tokens[0] == want[-1] and n_tokens[1] == 0 and fits[0] == (longest if want[-1] > limit else len(text))
    assert n_tokens[2:].tolist() == [len(x) for x in MODEL.encode([text + " word", "some words\nin lines"])]


@pytest.mark.parametrize("name", ["odd", "clashing", "documents", "none"])
def test_token_counts(request, name):
    docs = request.getfixturevalue(name)
    got = sorted(tuple(r) for r in tokencount.count_tokens(docs, PIECES).select("doc_id", "n_bytes", "n_tokens", "over_limit").fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n := len(MODEL.encode(r[1] or "")), n > 4096) for r in docs.select("doc_id", "text").collect())
    assert got == want


def check_pieces(docs, rows, size):
    """Every id lies in exactly one piece, sequences are full but for little padding."""
    wanted, found, sequences = defaultdict(list), defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for doc_id, text in docs.select("doc_id", "text").collect():
        wanted[doc_id].append([*ids_of(text), 0])
    for r in rows:
        sequences[r.sequence_id].append(r)
        found[r.doc_id][(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for doc_id, texts in wanted.items():
        assert sum(n * k[1] for k, n in found[doc_id].items()) == sum(map(len, texts))
        for (start, length, crc, total), _ in found[doc_id].items():
            assert any(len(t) == total and zlib.crc32(np.array(t[start : start + length], "<u4").tobytes()) == crc for t in texts)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    used = sum(r.length for r in rows)
    return used, sum(0 if (n := sum(p.length for p in ps)) & (n - 1) == 0 else size - n for ps in sequences.values())


@pytest.mark.parametrize("name", ["odd", "clashing", "documents"])
def test_packing(request, name):
    docs = request.getfixturevalue(name)
    rows = packing.pack(docs.repartition(5), BYTES, size=256, with_ids=True).collect()
    used, padding = check_pieces(docs, rows, 256)
    assert padding <= 256 + 0.02 * used


def test_packing_of_nothing_and_merging_over_levels(none, documents, monkeypatch):
    assert packing.pack(none, BYTES).count() == 0
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = documents.filter("doc_id < 60")
    rows = packing.pack(docs.repartition(7), BYTES, with_ids=True).collect()
    used, padding = check_pieces(docs, rows, 1024)
    assert padding <= 1024 + 0.02 * used and len({r.sequence_id for r in rows}) <= -(-used // 1024) * 1.02 + 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(0, 299), st.integers(0, 299))
def test_grammars_give_back_any_span(ids, a, b):
    symbols, left, right = repair.compress(np.array(ids, np.uint32), first=10, least=2)
    pairs, last = Counter(), None
    for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        if pair[0] != pair[1] or last != (pair, k - 1):  # overlapping pairs count once
            pairs[pair] += 1
            last = (pair, k)
    assert all(n < 2 for n in pairs.values())  # to the end
    grammar = repair.Grammar(left, right, repair.lengths_of(left, right, 10), symbols, first=10)
    assert grammar.ids().tolist() == ids
    a, b = min(a, len(ids)), min(b, len(ids))
    assert grammar.ids(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)]


def test_grammars_make_repeated_ids_short():
    for ids in (np.tile(np.arange(20), 20_000), np.full(100_000, 7), np.tile([3, 3, 3, 4], 50_000)):
        symbols, left, right = repair.compress(ids.astype(np.uint32), 50_257)
        grammar = repair.Grammar(left, right, repair.lengths_of(left, right, 50_257), symbols, 50_257)
        assert len(symbols) <= 64 and (grammar.ids() == ids).all()


def test_ids_of_any_size_come_back():
    ids = np.array([50_257, 7, 8, 70_000, 2**31] * 100, np.int64)
    row = repair._shard(0, 0, 0, ids[ids < 2**30], [1], [400]).to_pylist()[0]
    assert repair.grammar_of(row).ids().tolist() == [50_257, 7, 8, 70_000] * 100


@pytest.mark.parametrize("name", ["odd", "clashing", "documents", "none"])
def test_shards_round_trip(request, spark, name, monkeypatch):
    docs = request.getfixturevalue(name)
    path = repair.folder(spark)
    repair.write(docs, path, BYTES)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) for r in repair.read(spark, path, with_ids=True).collect()]
    got.sort(key=lambda r: r[1])
    ordered = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for doc_id, text in ordered:
        ids = [*ids_of(text), 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want


def test_counts_of_long_runs_of_signs():
    for text in ("😀" * 5000, "a" + "Ａ!" * 3000, "\n" * 4000 + "x", "!?" * 3000 + " end.", "日本語" * 2000):
        assert COUNTER.count(text) == len(MODEL.encode(text))
