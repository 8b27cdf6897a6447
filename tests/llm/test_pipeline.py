"""Each stage of the pipeline against brute force on its own input, and all of them on odd rows."""

from collections import Counter

import pytest
from test_documents import brute_kept, measure
from test_tokens import check_pieces

import corpus_pipeline
from tessella.llm import langid, mixing

STAGES = dict(corpus_pipeline.STAGES)


def kept_of_language(docs):
    """Rows that language ID keeps, judged one at a time."""
    model = langid.train(docs.filter(~langid.held_out()))
    out = []
    for r in docs.collect():
        if any(c.isalpha() for c in r.text or ""):
            best, share, bits = model.predict([r.text])
            if model.languages and share[0] >= 0.5 and bits[0] <= corpus_pipeline.MOST_BITS_PER_BYTE:
                out.append(r)
    return out


def kept_of_quality(docs):
    out = []
    for r in docs.collect():
        n, chars, symbols, lines, again, repeated = measure(r.text)
        if not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 100 * again > 50 * lines or chars < 2 * n or chars > 15 * n):
            out.append(r)
    return out


def test_every_stage_equals_brute_force(spark, documents, sf):
    docs = documents.union(documents.filter("doc_id < 20")).cache()
    held = lambda rows: sorted(map(repr, rows))

    after = STAGES["language_id"](spark, docs, sf).cache()
    assert held(after.collect()) == held(kept_of_language(docs)) and after.columns == docs.columns
    docs, after = after, STAGES["quality_rules"](spark, after, sf).cache()
    assert held(after.collect()) == held(kept_of_quality(docs))

    docs, after = after, STAGES["simhash_near_dedup"](spark, after, sf).cache()
    assert sorted((r.doc_id for r in after.collect()), key=repr) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert set(map(repr, after.collect())) <= set(map(repr, docs.collect()))

    docs, after = after, STAGES["mixing"](spark, after, sf).cache()
    sizes, taken = Counter(), Counter()
    for rows, total in ((docs, sizes), (after, taken)):
        for r in rows.collect():
            total[r.source] += measure(r.text)[0]
    goal, longest = mixing.targets(dict(sizes)), max(measure(r.text)[0] for r in docs.collect())
    assert all(abs(taken[s] - goal[s]) <= longest for s in sizes)
    times, own = Counter(map(repr, after.collect())), Counter(map(repr, docs.collect()))
    assert set(times) <= set(own) and all(n <= 3 * own[r] for r, n in times.items())

    pieces = [r.asDict() for r in STAGES["packing"](spark, after, sf).collect()]
    by_text = Counter((r.doc_id, r.text) for r in after.collect())
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter({d: n for (d, _), n in by_text.items()})
    used, padding = check_pieces(after, STAGES["packing"](spark, after, sf).collect(), 1024)
    assert padding <= 1024 + 0.02 * used


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_stages_take_odd_rows(request, spark, name, sf):
    docs = request.getfixturevalue(name)
    columns = docs.columns
    for stage, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, sf)
        if stage != "packing":
            assert docs.columns == columns
        docs.collect()


def test_run_returns_pieces_with_ids(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)
