"""Repeated passages wherever their cuts fall, against exact matching."""

import random

from marginalia.llm.substring_dedup import dedup_substrings, repeated_spans


def words(rng, n, size=5):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))


def test_passages_of_51_words_are_all_listed(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(0, 800, 2):
        passage = words(rng, 51)
        for d in (i, i + 1):
            lead = words(rng, rng.randrange(5, 40)) + " <" + "ab"[d % 2]
            rows.append((d, f"{lead}{passage}{'yz'[d % 2]}> {words(rng, 30)}"))
            want[d] = (len(lead), len(lead) + len(passage))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.start, r.end) for r in repeated_spans(frame).collect()}
    assert got == want


def test_limits_of_the_minimum_and_short_copies(spark):
    rng = random.Random(12)
    raw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, want = [], set()
    for i in range(0, 200, 2):
        n = (127, 128)[i // 2 % 2]
        same = raw(n)
        rows += [(i, f"{raw(90)}A{same}B{raw(99)}"), (i + 1, f"C{same}D{raw(150)}")]
        want |= {i, i + 1} if n == 128 else set()
    rows += [(300, "short copy"), (301, "short copy"), (302, "short one"), (303, "short one?"), (304, "twice"), (304, "twice"), (305, ""), (306, "")]
    out = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == want | {300, 301}
    assert (out[300].n_removed_bytes, out[301].n_removed_bytes, out[301].first_docs) == (0, 10, [300])


def brute(texts, span):
    """Bytes of each text that a string of ``span`` bytes covers which starts elsewhere too."""
    seen = {}
    for d, raw in enumerate(texts):
        for i in range(len(raw) - span + 1):
            seen.setdefault(raw[i : i + span], []).append((d, i))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d].update(range(i, i + span))
    return out


def test_spans_match_brute_force_where_rows_share_an_id(spark, sf_tiny):
    rng = random.Random(13)
    shared, other = words(rng, 40), words(rng, 40)
    rows = [(1, f"{words(rng, 20)} {shared} {words(rng, 9)}"), (1, f"{other} {words(rng, 30)}"), (2, f"{words(rng, 30)} {other}"), (3, shared)]
    rows += [(3, words(rng, 8000)), (4, None), (5, "")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    got = {}
    texts = [(t or "").encode() for _, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = [r.h for r in frame.selectExpr("xxhash64(coalesce(text, '')) AS h").collect()]
    for r in repeated_spans(frame).collect():
        got.setdefault((r.doc_id, r.text_h), set()).update(range(r.start, r.end))
    # Every span of 128 bytes is found; what is joined to it repeats over 80 bytes at least.
    for (d, _), h, raw, want, most in zip(rows, hashes, texts, brute(texts, 128), brute(texts, 80), strict=True):
        if len(raw) >= 128:
            assert want <= got.get((d, h), set()) <= most, d
