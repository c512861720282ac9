"""Runs, components, raking and the operators' SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from marginalia.llm import catalog, mixing
from marginalia.llm.components import connected_components
from marginalia.llm.vectors import runs


def test_runs_are_cut_at_keys():
    rng = random.Random(1)
    keys = np.sort(np.array([rng.randrange(300) for _ in range(10_000)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100])], names=["key"]) for i in range(0, len(keys), 100)]
    tables = [t["key"].to_numpy() for t in runs(iter(batches), "key")]
    assert np.concatenate(tables).tolist() == keys.tolist()
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
    assert max(map(len, tables)) < 250


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 3000) if i % 1000] + [(5000, 5001), (5001, 5000), (7, 7)]
    rng.shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: (i - 1) // 1000 * 1000 + 1 for i in range(1, 3001) if (i - 1) // 1000 * 1000 + 1000 >= i} | {5000: 5000, 5001: 5000}


def test_raking_by_arrays_and_by_tables_agree(spark):
    rng = random.Random(3)
    rows = [(f"s{a}" if a else None, f"l{b}", f"t{c}", rng.randrange(0, 900)) for a in range(5) for b in range(3) for c in range(4) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {m: mixing.smoothed_targets(cells, m, 0.3) for m in mixing.MARGINS}
    one, other = (sorted(map(tuple, mixing.rake(cells, targets, array_cells=n).collect()), key=str) for n in (1000, 1))
    assert [r[:4] for r in one] == [r[:4] for r in other]
    assert [r[4] for r in one] == pytest.approx([r[4] for r in other], rel=1e-8)
    assert max(r[5] for r in one + other) <= 1e-10
    for i, m in enumerate(mixing.MARGINS):
        for value, target in targets[m].collect():
            assert sum(r[4] for r in one if r[i] == value) == pytest.approx(target, rel=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_tiny, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        path = f"{sf_tiny}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    plain = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    ordered = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    got = catalog.queries()[name](spark, sf_tiny)
    columns = sorted(got.columns)
    want = c.sql(catalog.oracle_sql()[name])
    assert ordered(got.select(*columns).collect()) == ordered(want.select(*columns).fetchall())


def test_components_of_many_edges_are_the_same(spark, monkeypatch):
    from marginalia.llm import components

    rng = random.Random(4)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(rows, "a long, b long")
    one = dict(map(tuple, connected_components(edges).collect()))
    monkeypatch.setattr(components, "BROADCAST_ROWS", 1)
    assert dict(map(tuple, connected_components(edges).collect())) == one
