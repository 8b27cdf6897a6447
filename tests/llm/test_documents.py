"""Mixing, quality, language, near-duplicates, against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import langid, mixing, quality, simhash
from tessella.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["odd", "clashing", "documents", "none"]


def test_targets_stop_at_three_times_a_source():
    got = mixing.targets({"a": 10, "b": 1000, None: 5, "c": 100})
    assert got == {"a": 30.0, "b": 770.0, "c": 300.0, None: 15.0} and sum(got.values()) == 1115


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 400))
def test_the_fit_is_the_best_that_its_documents_allow(documents, budget):
    lengths, counts = zip(*sorted(documents.items()))
    took = mixing.fit(list(lengths), list(counts), budget)
    assert all(0 <= k <= c for k, c in zip(took, counts))
    sums = {sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*(range(c + 1) for c in counts))}
    got = sum(n * k for n, k in zip(lengths, took))
    near = min(abs(s - budget) for s in sums)
    assert abs(got - budget) <= near + max(lengths) / 2


def test_the_fit_needs_little_memory():
    import tracemalloc

    lengths = [*range(2, 40_002, 2), 1_000_000]
    tracemalloc.start()
    took = mixing.fit(lengths, [1] * len(lengths), 123_457)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert abs(sum(n * k for n, k in zip(lengths, took)) - 123_457) == 1


@pytest.mark.parametrize("name", NAMES)
def test_mixing(request, name):
    docs = request.getfixturevalue(name)
    rows = [r.asDict() for r in mixing.mix(docs, 7, 3.0, mixing.WEIGHTS, None, "source").collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(3), 7, 3.0, mixing.WEIGHTS, None, "source").collect()]
    key = lambda r: repr(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = Counter()
    for source, text in docs.select("source", "text").collect():
        sizes[source] += len(WORD.findall(text or ""))
    goal = mixing.targets(dict(sizes))
    took = Counter()
    for r in rows:
        took[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] <= 3 * r["size"]
    assert len(rows) == docs.count()
    if name == "documents":
        assert all(abs(took[s] - goal[s]) <= max(r["size"] for r in rows if r["source"] == s) for s in goal)


def test_mixed_documents_keep_their_columns(clashing):
    got = mixing.mixed(clashing)
    assert got.columns == clashing.columns and got.count() > 0
    times = Counter(tuple(r) for r in got.select("doc_id", "text").collect())
    want = Counter()
    for r in mixing.mix(clashing, 7, 3.0, mixing.WEIGHTS, None, "text").collect():
        want[r.doc_id, r.text] += r.taken // r["size"] if r.taken else 0
    assert times == +want


def measure(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = {i + k for i in range(len(ws) - 2) if at[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("name", NAMES)
def test_quality(request, name):
    docs = request.getfixturevalue(name)
    entries = quality.judged(quality.ledger(docs, "doc_id"))
    got = sorted(repr(tuple(r)[:7]) for r in entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(repr((r[0], *measure(r[1]))) for r in docs.select("doc_id", "text").collect())
    for r in entries.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == entries.filter("kept").count()


def test_ablations_are_what_filtering_again_gives(documents):
    entries = quality.ledger(documents, "doc_id").cache()
    for r in quality.ablations(entries).collect():
        mask = quality.bits(quality.POLICIES[r.policy])
        without = mask & ~quality.bits((r.rule,))
        assert r.kept == entries.filter(f"failures & {mask} = 0").count() and r.kept_without == entries.filter(f"failures & {without} = 0").count()


def test_quality_runs_no_python(documents):
    plan = quality.filtered(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.98 * len(got) > 200
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_language_of_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    blank = {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert all((r.lang_pred == "und") == (r.doc_id in blank) for r in got)


def test_rows_without_an_id_are_learned_from(spark):
    docs = spark.createDataFrame([(None, f"some words of english prose, number {i}", "en") for i in range(1500)] + [(None, "ein und derselbe deutsche Satz", "de")] * 1500, "doc_id long, text string, lang string")
    got = langid.identify(docs).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 1500, "de": 1500}


def test_code_lengths_are_those_of_the_definition():
    texts = ["abracadabra", "banana bandana", "abba"]
    gram, count = langid._grams(texts)
    model = langid.build(["x"], np.zeros(len(gram), int), gram, count)
    seen = Counter()
    for t in texts:
        raw = langid.PAD + t.encode()
        for i in range(langid.ORDER, len(raw)):
            for k in range(langid.ORDER + 1):
                seen[raw[i - k : i], raw[i]] += 1
    often = Counter()
    for (context, _), n in seen.items():
        often[context] += n

    def share(context, byte):
        if len(context) == 0 and not often[b""]:
            return 1 / 256
        if len(context) > 0 and often[context] < 2:
            return share(context[1:], byte)
        here = {b: n for (c, b), n in seen.items() if c == context}
        total = sum(here.values()) + len(here)
        if byte in here:
            return here[byte] / total
        lower = (lambda b: share(context[1:], b)) if context else (lambda b: 1 / 256)
        return len(here) / total * lower(byte) / (1 - sum(lower(b) for b in here))

    for text in ("abracadabra", "bandit", "zebra é", "a"):
        raw = langid.PAD + text.encode()
        want = sum(-np.log2(share(raw[i - langid.ORDER : i], raw[i])) for i in range(langid.ORDER, len(raw)))
        assert model.lengths([text])[0, 0] / langid.UNIT == pytest.approx(want, abs=1e-3 * len(raw))


def test_lengths_do_not_depend_on_the_batch():
    texts = ["hello there", "", "x", "another text, longer than that"]
    gram, count = langid._grams(texts)
    model = langid.build(["x"], np.zeros(len(gram), int), gram, count)
    assert [model.lengths([t])[0, 0] for t in texts] == model.lengths(texts)[:, 0].tolist()


def print_of(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, linked):
    """Smallest id reachable, for (id, fingerprint) rows."""
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if linked(rows[i][1], rows[j][1]):
            name[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("name", NAMES)
def test_simhash_components(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r[0], print_of(r[1])) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, lambda a, b: (a ^ b).bit_count() <= 4)
    got = sorted(repr(tuple(r)) for r in simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted(repr((d, f"{p:016x}", c)) for (d, p), c in zip(rows, want))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == brute_kept(texts)


def near_prints(rng, n):
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    out = []
    for _ in range(n):
        p = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            p ^= 1 << int(b)
        out.append(p)
    return out


@pytest.mark.parametrize("rows_of_a_key,bits", [(simhash.KEY_ROWS, 0), (4, 0), (simhash.KEY_ROWS, 5), (simhash.KEY_ROWS, 13)])
def test_all_links_are_found(spark, monkeypatch, rows_of_a_key, bits):
    monkeypatch.setattr(simhash, "KEY_ROWS", rows_of_a_key)
    monkeypatch.setattr(simhash, "deal_bits", lambda rows: bits)
    prints = near_prints(np.random.default_rng(3), 400)
    rows = list(enumerate(prints))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash.near_duplicates(df), "fp").collect()}
    want = brute_components(rows, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == dict(enumerate(want))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**23 - 1), st.lists(st.integers(0, 22), max_size=2))
def test_segments_that_differ_in_two_bits_share_a_key(word, bits):
    other = word
    for b in bits:
        other ^= 1 << b
    a, b = simhash.segment_keys(np.array([word, other]))
    assert set(a[a >= 0]) & set(b[b >= 0])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    texts = [[words[k] for k in rng.integers(0, 4000, 300)] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:15]):  # one word in 300 changed: 5 of 296 shingles
        rows.append((100 + i, " ".join([*t[:150], "other", *t[151:]])))
        rows.append((200 + i, " ".join(t)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(30)) and not kept & set(range(200, 215)) and len(kept & set(range(100, 115))) <= 1


def shingled(text, width=5):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def agree(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    """doc_ids that stay of (doc_id, text) rows, sorted."""
    roots = brute_components([(i, shingled(text)) for i, (_, text) in enumerate(rows)], agree)
    groups = {}
    for (doc_id, _), root in zip(rows, roots):
        groups.setdefault(root, []).append(doc_id)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=repr)


def changed(rng, words, n):
    """The words with ``n`` of them changed, anywhere."""
    words = list(words)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"new{rng.integers(0, 10**9)}"
    return words


@pytest.fixture(scope="module")
def related():
    """Texts, and for each some with 2 to 12 of 200 words changed: Jaccard indices of 0.55 to 0.95."""
    rng = np.random.default_rng(11)
    texts = [[f"w{k}" for k in rng.integers(0, 3000, 200)] for _ in range(60)]
    return [(100 * i + n, " ".join(changed(rng, t, n) if n else t)) for i, t in enumerate(texts) for n in [0, int(rng.integers(2, 13))]]


def test_all_near_duplicates_go(spark, related):
    linked = sum(agree(shingled(a), shingled(b)) for (_, a), (_, b) in zip(related[::2], related[1::2]))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(related, "doc_id long, text string")).collect()}
    assert 10 < linked < 50 and not any(b in kept for (_, s), (b, t) in zip(related[::2], related[1::2]) if agree(shingled(s), shingled(t)))


@pytest.mark.parametrize("block", [simhash.BLOCK_DOCS, 7])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    """One passage in all, near copies of one text, and near copies of near copies."""
    monkeypatch.setattr(simhash, "BLOCK_DOCS", block)
    rng = np.random.default_rng(12)
    passage, text = [f"p{k}" for k in range(60)], [f"t{k}" for k in range(150)]
    rows = [(i, " ".join([*passage, *(f"u{k}" for k in rng.integers(0, 10**6, int(rng.integers(5, 120))))])) for i in range(60)]
    rows += [(1000 + i, " ".join(changed(rng, text, int(rng.integers(0, 6))))) for i in range(60)]
    for i in range(40):
        text = changed(rng, text, 3)
        rows.append((2000 + i, " ".join(text)))
    rows += [(None, "none"), (None, "none"), (3000, None), (3001, "  "), (3002, "NONE")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in got), key=repr) == brute_kept(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), min_size=1, max_size=50), st.booleans())
def test_sets_that_agree_are_linked(sets, many):
    sets = sets * 2 if many else sets
    sets = [s | {100 + i} for i, s in enumerate(sets)] if len(sets) % 2 else [s | {99} for s in sets]
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    a, b = simhash.agreeing(np.concatenate(arrays), np.array([len(x) for x in arrays]), 0.8)
    assert all(agree(sets[i], sets[j]) for i, j in zip(a, b))
    name = list(range(len(sets)))
    for i, j in zip(a.tolist(), b.tolist()):
        old, new = name[j], name[i]
        name = [new if x == old else x for x in name]
    assert all(name[i] == name[j] for i, j in itertools.combinations(range(len(sets)), 2) if agree(sets[i], sets[j]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_stars_keep_the_components(edges):
    a, b = np.array([x for x, _ in edges], np.int64), np.array([y for _, y in edges], np.int64)
    name = {x: x for e in edges for x in e}
    for x, y in edges:
        old, new = max(name[x], name[y]), min(name[x], name[y])
        name = {k: new if v == old else v for k, v in name.items()}
    assert sorted(map(tuple, simhash.stars(a, b).tolist())) == sorted((v, k) for k, v in name.items() if k != v)
