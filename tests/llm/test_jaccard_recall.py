"""Recall inside a family of many different texts from one template."""

import random

from marginalia.llm.jaccard_join import jaccard_join, runs_for


def family(pairs, n=400, edits=8):
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(n)], []
    for i in range(pairs):
        at = [5 + 24 * j + rng.randrange(18) for j in rng.sample(range(16), 16)]
        one = [f"p{i}x{k}" if k in at[:edits] else w for k, w in enumerate(base)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(f"q{i}x{k}" if k in at[edits:] else w for k, w in enumerate(one)))]
    return rows


def test_border_pairs_of_a_template_keep_their_link(spark):
    rows = family(600)
    words = lambda t: {t[j : j + 5] for j in range(396)}
    a, b = (words(tuple(t.split())) for _, t in rows[:2])
    assert 0.8 <= len(a & b) / len(a | b) <= 0.82
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: v for d, v in out.items() if v != (d // 2 * 2, 1)} == {}


def test_runs_cover_the_shared_coordinates():
    assert runs_for(0.99999, 0.8, 3) > 12
    assert runs_for(0.99999, 0.8, 8) > runs_for(0.99999, 0.8, 3)
