import itertools

import pytest
from marginalia.llm.jaccard_join import jaccard_join, runs_for


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
            n[i] += 1
            n[j] += 1
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)], n[i]) for i, (d, _) in enumerate(rows))


def test_matches_brute_force(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    base = rows[3][1].split()
    extra = [(1000 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(12)]
    extra += [(2000, "one two"), (2001, "one two"), (2002, ""), (2003, None), (2004, "   \n"), (2005, "one two three")]
    rows += extra
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == brute(rows)


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 120], f"edit{i}", *words[i % 120 + 1 :]])) for i in range(400)]
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == brute(rows)


def test_empty_table_and_null_id(spark):
    schema = "doc_id long, text string, class_id string"
    assert jaccard_join(spark.createDataFrame([], schema)).collect() == []
    out = jaccard_join(spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "y")], schema)).collect()
    assert sorted(map(tuple, out), key=str) == [(1, 1, 0), (None, None, 0)]


def test_runs_follow_recall():
    assert runs_for(0.9, 0.8) < runs_for(0.999, 0.8)
    assert runs_for(0.99, 0.8) == pytest.approx(5, abs=1)


def test_shared_ids_repeated_rows_and_a_long_text(spark):
    text = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    near = lambda t: t.replace("30 ", "30x ", 1)
    a, b, long = text("a"), text("b"), text("c", 40_000)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, long), (5, near(long)), (5, near(long)), (6, a)]
    out = sorted(map(tuple, jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == brute(rows)
    assert {r[0]: r[2] for r in out}[3] == 1
