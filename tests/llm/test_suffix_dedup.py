import hashlib
import random

import pytest
from marginalia.llm.suffix_array import suffix_array
from marginalia.llm.suffix_dedup import dedup_suffixes


def test_suffix_array_matches_sorting():
    rng = random.Random(5)
    for _ in range(3000):
        k = rng.choice([1, 2, 3, 5])
        text = [rng.randint(1, k) for _ in range(rng.randint(0, 30))] + [0]
        assert list(suffix_array(text)) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length):
    seen = {}
    for d, raw in enumerate(texts):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((d, i))
    gone = [bytearray(len(raw)) for raw in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for raw, g in zip(texts, gone, strict=True):
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        runs = sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1]))
        out.append((len(raw), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [16_384, 1])
def test_matches_brute_force(spark, sf_tiny, hot):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(400))
    texts = [base, base[:900] + "X" + base[901:], "q" + base[300:1200], base[100:520] + "yy" + base[:430], None, "", "ab " * 500]
    texts += [base[i * 7 : i * 7 + 600] + str(i) * 50 for i in range(12)]
    texts += [r[0] for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("text").limit(120).collect()]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    out = dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    want = brute([(t or "").encode() for t in texts], 400)
    got = {3 if r.doc_id is None else r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert [got[i] for i in range(len(texts))] == want
    repeated = {3 if r.doc_id is None else r.doc_id: r.n_repeated for r in out}
    assert [repeated[i] for i in range(len(texts))] == [w[1] for w in brute([(t or "").encode() for t in texts], 224)]


def test_long_texts_repeated_rows_and_shared_ids(spark):
    rng = random.Random(8)
    raw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    big = raw(300_000)
    texts = [big, raw(2000) + big[100_000:100_900] + raw(50), raw(500), raw(500), "\0\1" * 400]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[3]), (None, texts[3]), (3, texts[4])]
    out = dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([t.encode() for _, t in rows], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)


def test_empty_table(spark):
    assert dedup_suffixes(spark.createDataFrame([], "doc_id long, text string, span int")).collect() == []
