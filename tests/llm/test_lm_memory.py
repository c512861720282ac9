"""Memory that op3's tasks need beside what they read."""

import tracemalloc

import numpy as np
import pyarrow as pa
from marginalia.llm import lm_score


class Shared:
    def __init__(self, value):
        self.value = value


def _peak(work):
    tracemalloc.start()
    try:
        got = list(work())
        return got, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_is_worked_on_in_steps():
    """A bucket of a million bigrams needs at most 50 bytes for each."""
    r, docs, each = np.random.default_rng(1), 4000, 250
    n = docs * each
    models = lm_score.Models(np.arange(100, dtype=np.uint64), 10, np.ones((2, 102)) * 50, np.ones((2, 102)) * 50, np.zeros(0, np.int64), np.zeros((2, 0)))
    entry = {"gram": r.integers(0, 300_000, n), "symbol": r.integers(0, 101, n), "own": np.ones(n), "n": np.ones(n)}
    doc = {"id": np.arange(docs), "h": np.arange(docs), "length": np.full(docs, 500) + np.arange(docs) % 2, "size": np.full(docs, each)}
    at = np.arange(0, docs + 1, 40)
    packed = [lm_score._packed({**doc, **entry}[k], at if k in doc else at * each, kind) for k, kind in lm_score.PACKED.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(100, np.int64)), pa.array(np.arange(100)), *packed], names=["bucket", "piece", *lm_score.PACKED])
    got, peak = _peak(lambda: lm_score._corrections(Shared(models))(iter([batch])))
    assert sum(len(b) // 8 for b in got[0].column("id").to_pylist()) == docs
    assert peak <= 50 * n


def test_bigrams_are_counted_in_parts():
    """Counting a batch of 2.4 million words needs no arrays of its length."""
    rows = [" ".join(map(str, range(k, k + 60_000))).encode() for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([1] * 40)], names=["text", "target"])
    words = np.unique(lm_score.word_hashes(np.frombuffer(b" ".join(rows), np.uint8), np.array([0, sum(map(len, rows)) + 39]))[1])

    def work():
        for b in lm_score._gram_counts(words)(iter([batch])):
            yield b.num_rows, int(b.column("n_target").to_numpy().sum())

    got, peak = _peak(work)
    assert sum(n for _, n in got) == 2_400_000 and max(n for n, _ in got) <= lm_score.STEP
    assert peak < 70_000_000


def test_a_partition_holds_one_bucket(spark):
    """What a task reads, sorts and sends to its worker is one bucket, whatever its number."""
    rows = spark.range(0, 650, 1, 8).selectExpr("id % 65 AS bucket", "id AS piece")
    per_task = lm_score.dealt(rows, 65).selectExpr("spark_partition_id() AS p", "bucket").distinct().groupBy("p").count().collect()
    assert sorted(r["p"] for r in per_task) == list(range(65)) and all(r["count"] == 1 for r in per_task)
