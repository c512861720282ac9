"""Thresholds of the personal-data kinds come from all candidates."""

import pytest
from marginalia.llm.pii import calibrated, find_pii, shares


def test_rare_kind_keeps_its_spans_beside_a_hot_one(spark):
    rows = [(i, f"item {10_000_000 + i} of the list") for i in range(6000)]
    rows += [(6000 + i, f"call phone 030 {100 + i} {4000 + i} now") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in find_pii(frame, max_rows=100).collect()}
    assert sum("local:" in out[6000 + i] for i in range(60)) == 60


def test_shares_and_cuts():
    out = shares({"digits": 1_000_000, "local": 100, "secret": 4000}, 1000)
    assert out["local"] == 0.5 and out["secret"] * 4000 == pytest.approx(475) and out["digits"] * 1_000_000 == pytest.approx(475)
    cuts = calibrated([("local", 9, 10, 10), ("local", 5, 10, 9), ("local", 1, 80, 0), ("secret", 3, 10, 1)], 0.95)
    assert cuts["local"] == 5 and cuts["secret"] == float("inf") and cuts["digits"] == float("inf")
