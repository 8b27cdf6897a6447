"""Chats, URLs, neighbours, and the pipeline."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import ann, chat, urls
from tessella.llm.queries import URL_RULES

TEXT = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "|", "\\", "<\\|", "a", "\n", "é", "assistant", ""]), max_size=6).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys<|em", ""]), TEXT), min_size=1, max_size=5))
def test_chats_come_back(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.canonical_turns(rows))
    got = chat.read_back(made).first()
    assert [(t.role, t.text) for t in got.turns] == turns
    assert "".join(got.loss_texts) == "".join(t for r, t in turns if r == "assistant")
    row = chat.digests(chat.read_back(made)).first()
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.n_turns == len(turns)
    mask = made.first()
    assert sum(m.before + m.loss + m.after for m in mask.loss_mask) == len(mask.formatted)


def test_chat_rows_that_are_odd(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", None, "x"), (1, 1, "user", "hi", "x"), (1, 1, "user", "hi", "x"), (None, None, None, None, "x"), (2, None, "assistant", "b", "x"), (2, None, "assistant", "a", "x")], "conv_id long, turn long, role string, text string, pieces string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(chat.canonical_turns(rows))).collect()}
    assert got == {1: [("user", "hi"), ("user", "hi"), ("assistant", "")], None: [("", "")], 2: [("assistant", "a"), ("assistant", "b")]}
    assert chat.digests(chat.read_back(chat.formatted(chat.canonical_turns(rows.limit(0))))).count() == 0


def test_layouts_are_known_by_their_fingerprint(spark):
    both = [("user", "q"), ("assistant", "a")]
    texts = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"}, {"response": "a", "prompt": "q"},
        {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a"}, {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        {"messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a"}], "id": 1}, {"prompt": "q", "response": "a", "score": 0.5}, {"instruction": "q", "input": None, "output": "a", "id": [1]},
    ]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate([*texts, {"what": 1}])] + [(99, "no json"), (98, None)], "id long, j string")
    got = {r.id: r.turns and [(t.role, t.text) for t in r.turns] for r in df.select("id", chat.turns_of_json(F.col("j")).alias("turns")).collect()}
    assert all(got[i] == both for i in range(len(texts))) and got[len(texts)] is got[99] is got[98] is None
    assert spark.range(1).select(chat.turns_of_json(F.lit('{"messages": [], "id": 1}')).alias("t")).first().t == []
    table = spark.createDataFrame([(1, "q", "a", "z")], "conv_id long, prompt string, response string, other string")
    assert [(t.role, t.text) for t in chat.canonical_turns(table).first().turns] == both
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(table.select("conv_id", "other"))


def test_chat_runs_no_python(spark, sf):
    plan = chat.digests(chat.read_back(chat.formatted(chat.canonical_turns(spark.read.parquet(f"{sf}/conversations.parquet")))))._jdf.queryExecution().toString()
    assert "Python" not in plan


URLS = [None, "", "no scheme", "http://", "https://A.example.org/es/x?y#z", "http://example.org/en/1", "http://example.org/en/12", "http://xexample.org/es/", "http://org", "http://org/", "ftp://a.com/fr/1", "http://b.a.com/de/", "http://b.a.com/de", "http://c.net/", "x://y://z.org/q", "http://example.org/es/", "http://example.org/es/", "http://ORG?/es/", "http://a..org/\n", "http://é.org/es/"]


def brute(url, rules, otherwise="allow"):
    if url is None or "://" not in url:
        return "", "", None, otherwise
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0] or [len(path)])]
    fits = [(-len(h + p), -len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(min(fits)[2:] if fits else (None, otherwise)))


MORE = [("a.com", "/de/", "allow"), ("example.org", "", "block"), ("net", "/", "block"), ("b.a.com", "/de/", "block"), ("example.org", "/es/x", "allow"), ("x.example.org", "/a/b/c", "block")]


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES + MORE, []])
def test_url_rules(spark, rules, monkeypatch):
    monkeypatch.setattr(urls, "PER_RANGE", 2)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, row string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in urls.judge(pages, table).fillna("-", ["rule"]).collect())
    assert got == sorted((i, *(x if x is not None else "-" for x in brute(u, rules))) for i, u in enumerate(URLS))
    assert urls.judge(pages.limit(0), table).count() == 0


def test_url_ranges_split_a_very_frequent_url(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://www.example.org/es/1" if i % 3 else f"http://h{i % 50}.com/{('fr', 'de')[i % 2]}/{i}") for i in range(60_000)], "page_id long, url string")
    table = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urls.judge(pages, table).groupBy("rule").count().collect()
    want = {"example.org/es/": 40_000, "com/fr/": sum(not i % 3 and not i % 2 for i in range(60_000)), "com/de/": sum(not i % 3 and i % 2 for i in range(60_000))}
    assert {r[0]: r[1] for r in got} == want


def exact(rows, queries, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if queries(q):
            near = sorted((-float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [1.0, 2.0]), (2010, [float("inf")] + [1.0] * 7), rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cell string, score int")
    want = exact(rows, lambda q: q % 10 == 0)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 5 * len(want)
    # copies: the smallest ids, and never the query itself
    assert [i for i, _ in got[1000]] == [3, 1001, 1002, 1003, 1004]
    for q, near in got.items():
        assert all(abs(s - dict(exact([(q, dict(rows)[q]), (i, dict(rows)[i])], lambda x: x == q)[q])[i]) < 1e-12 for i, s in near)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_query_rows_lose_no_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 40)]
    rows += [(0, rng.normal(size=8).tolist())] * 5 + [(7, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, cells=2).orderBy("rank").collect()]
    best = {}
    for i, s in exact(rows, lambda q: q == 0, 40)[0]:
        best.setdefault(i, s)
    assert got == [(0, k + 1, i) for k, i in enumerate(sorted(best, key=lambda i: -best[i])[:5])]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_on_the_table(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        found += len(got[q] & set(ids[np.argsort(-s)[:5]]))
    assert len(got) == (ids % 50 == 0).sum() and found >= 0.9 * 5 * len(got)


def rows_of(kind, n=3000, d=16):
    rng = np.random.default_rng(5)
    if kind == "one direction":  # no code tells these apart
        return np.eye(d)[0] + 1e-4 * rng.normal(size=(n, d))
    if kind == "far queries":  # the queries are like no row of the sample
        x = np.eye(d)[rng.integers(4, size=n)] + 0.1 * rng.normal(size=(n, d))
        x[::50] = rng.normal(size=(len(x[::50]), d))
        return x
    if kind == "tight groups":
        return rng.normal(size=(20, d))[rng.integers(20, size=n)] + 1e-3 * rng.normal(size=(n, d))
    return rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["one direction", "far queries", "tight groups", "no structure"])
@pytest.mark.parametrize("lot", [None, 40])
def test_nearest_of_any_rows(spark, kind, lot, monkeypatch):
    if lot:  # many lots, cells over several, queries over several tasks
        monkeypatch.setattr(ann, "LOT", (lot, lot))
        monkeypatch.setattr(ann, "QUERIES", 7)
    x = rows_of(kind)
    ids = np.arange(len(x))
    ids[7::100] = ids[8::100]  # several vectors with one id
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    for q, near in got.items():
        best = {}
        for i, s in zip(ids.tolist(), (unit @ unit[ids == q].T).max(axis=1)):
            if i != q:
                best[i] = max(s, best.get(i, -2))
        want = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:5]
        assert [i for i, _ in near] == [i for i, _ in want] and np.allclose([s for _, s in near], [s for _, s in want], rtol=0, atol=1e-12)
