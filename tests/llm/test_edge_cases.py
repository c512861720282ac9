"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from marginalia.llm import decontaminate, line_dedup, lm_score, mixing, quality_classifier, quality_rules, substring_dedup
from marginalia.llm.line_dedup import keep_mask
from marginalia.llm.lm_score import BACKOFF
from marginalia.llm.substring_dedup import chunk_ends, gear_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, path string, n_words string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
SHARED = "this is a line that many documents share"


def rows():
    plain = [
        (0, "a plain text of exactly ten words is kept by rules", "en", "s0"),
        (1, None, "en", "s0"),
        (2, "", "fr", None),
        (3, " \t\n\x0b ", None, None),
        (4, LONG, "en", "s0"),
        (5, f"{SHARED}\n{SHARED}\nx", "en", "s1"),
        (6, f"  {SHARED.upper()}\t\ny", "en", "s1"),
        (7, f"{SHARED}\nlast", "de", "s1"),
        (7, f"{SHARED}\nlast", "de", "s1"),
        (None, f"{SHARED}\nnull id", "de", "s1"),
        (8, "spam spam spam spam spam spam spam spam spam spam spam spam", "en", "s0"),
    ]
    return [(d, t, la, s, None, 1, "p", "w") for d, t, la, s in plain]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    out = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=str)
    kept = {(r[0], r[1], r[2]): r[4] for r in out}
    assert len(out) == len(rows())
    assert kept[(5, 3, 2)] == "x"
    assert kept[(6, 2, 1)] == "y"
    assert kept[(7, 2, 0)] == f"{SHARED}\nlast"
    assert kept[(None, 2, 1)] == "null id"  # one document, less than all others
    assert kept[(1, 1, 0)] == ""
    assert all(r[3] == hashlib.sha256(r[4].encode()).hexdigest() for r in out)
    assert line_dedup.dedup_lines(none).collect() == []


def test_keep_bitmap_round_trip():
    assert keep_mask(None, 3).all()
    packed = line_dedup._pack.func(__import__("pandas").Series([np.array([0, 9, 30])]))[0]
    mask = keep_mask(packed, 50)
    assert sorted(np.flatnonzero(~mask)) == [0, 9, 30]


def test_quality_rules(docs, none):
    out = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs).collect()}
    assert out[(0, 11)].kept and not out[(0, 11)].base_failed
    assert out[(1, 0)].base_failed and out[(3, 0)].n_words == 0
    assert out[(8, 12)].n_repeat_words == 12 and out[(8, 12)].base_failed
    assert out[(5, 17)].n_dup_lines == 1
    assert out[(4, 60000)].n_repeat_words == 60000
    assert len(quality_rules.quality_rules(docs).collect()) == len(rows())
    assert quality_rules.quality_rules(none).collect() == []


def test_decontamination(spark, docs, none):
    words = [f"w{i}" for i in range(30)]
    more = docs.unionByName(
        spark.createDataFrame([(20, "X " + " ".join(words[5:20]).upper() + "! y", "en", "s", None, 1, "p", "w"), (21, "short one, here", "en", "s", None, 1, "p", "w")], SCHEMA)
    )
    items = spark.createDataFrame([(3, " ".join(words)), (10, "Short ONE"), (4, None), (5, ""), (6, "never seen"), (None, "a plain text")], "item_id long, text string")
    out = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(more, items).collect()}
    assert out[(20, 17)].n_hit == 15 and out[(20, 17)].n_items == 1 and out[(20, 17)].contaminated
    assert out[(21, 3)].n_hit == 2 and out[(21, 3)].items_sha256 == hashlib.sha256(b"10").hexdigest()
    assert sum(r.contaminated for r in out.values()) == 2
    assert len(decontaminate.contamination(docs, items.limit(0)).collect()) == len(rows())
    assert decontaminate.contamination(none, items).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta q q q q q q alpha")], "doc_id long, text string")
    phrases = decontaminate.phrases_of(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    anchors = decontaminate.anchor_terms(docs, phrases)
    postings = decontaminate.build_postings(docs, anchors)
    assert [r.doc_id for r in decontaminate.proximity_matches(docs, phrases, postings, anchors, 2).collect()] == [1]


@pytest.mark.parametrize(("max_words", "max_grams", "bucket"), [(2, 3, 1 << 22), (2, 0, 5), (3, 2, 3), (0, 0, 4), (100, 100, 2)])
def test_lm_scores_match_brute_force(spark, docs, none, monkeypatch, max_words, max_grams, bucket):
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    texts = [("a b a b c", True), ("b a q a\tb", False), ("", False), (None, True), ("a b c a b rare", True), ("c c a b", False), ("a b", False)]
    texts += [("q rare rare b", False), ("b rare q a rare", True)]
    # Rows are told apart by id and text; a repeated row counts twice.
    table = [(i, t, good) for i, (t, good) in enumerate(texts)] + [(5, "c c a b", False), (5, "rare rare c", False), (None, "b rare", False)]
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t, _ in table], "doc_id long, text string, gram string, bucket long")
    target = spark.createDataFrame([(i,) for i, (_, good) in enumerate(texts) if good], "doc_id long")
    words = [(t or "").split() for _, t, _ in table]
    count = lambda seqs: {x: sum(s.count(x) for s in seqs) for s in seqs for x in s}
    totals = count(words)
    least = min((n for n in totals.values() if sum(m >= n for m in totals.values()) <= max_words), default=10**9)
    vocabulary = {w for w, n in totals.items() if n >= least}
    symbol = lambda w: w if w in vocabulary else "?"
    pairs = [list(zip(["^", *map(symbol, ws)], ws)) for ws in words]

    def bits(i, good):
        left = [j for j, (_, _, g) in enumerate(table) if g == good and j != i]
        single, double = count([[symbol(w) for w in words[j]] for j in left]), count([pairs[j] for j in left])
        total = 0.0
        for v, w in pairs[i]:
            p = (single.get(symbol(w), 0) + BACKOFF / (len(vocabulary) + 1)) / (sum(single.values()) + BACKOFF)
            p = p if w in vocabulary else p / (len(totals) - len(vocabulary))
            context = sum(n for g, n in double.items() if g[0] == v)
            total -= math.log2((double.get((v, w), 0) + BACKOFF * p) / (context + BACKOFF))
        return total / max(len(pairs[i]), 1)

    got = lm_score.cross_entropy_difference(frame, target, max_words=max_words, max_grams=max_grams).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 9) for x in r[1:]))
    wanted = [(i, len(words[j]), bits(j, True), bits(j, False)) for j, (i, _, _) in enumerate(table)]
    for one, other in zip(sorted((tuple(r)[:4] for r in got), key=key), sorted(wanted, key=key), strict=True):
        assert one[:2] == other[:2] and one[2:] == pytest.approx(other[2:])
    if max_words == 2:
        assert len(lm_score.cross_entropy_difference(docs, target.limit(0)).collect()) == len(rows())
        assert lm_score.cross_entropy_difference(none, target).collect() == []


def test_chunks_survive_an_insertion():
    rng = random.Random(2)
    base = bytes(rng.randrange(256) for _ in range(8000))
    cut = lambda raw: chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), gear_table(), 5, 256)[0]
    pieces = lambda raw: {raw[a:b] for a, b in zip([0, *cut(raw)[:-1]], cut(raw), strict=True)}
    one, other = pieces(base), pieces(b"inserted at the front" + base)
    assert b"".join(base[a:b] for a, b in zip([0, *cut(base)[:-1]], cut(base), strict=True)) == base
    assert len(one & other) > 0.9 * len(one)


def test_substring_dedup(spark, docs, none):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = prose(60)
    extra = [(i, f"{prose(80)} {passage} {prose(70)}") for i in (30, 31, 32)] + [(33, prose(200))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, d1 string")
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame).collect()}
    assert sorted(out) == [30, 31, 32]
    assert out[30].n_removed_bytes == 0 and out[31].n_removed_bytes > 200 and out[32].first_docs == [30]
    assert 7 not in {r.doc_id for r in substring_dedup.dedup_substrings(docs).collect()}
    assert substring_dedup.dedup_substrings(none).collect() == []


def test_classifier_on_held_out_rows(spark, sf_tiny, docs, none):
    frame, labels = (spark.read.parquet(f"{sf_tiny.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.classify(frame, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.93
    odd = quality_classifier.classify(docs, labels).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).collect() == []


def test_mixing_meets_its_margins(spark, docs, none):
    frame = spark.createDataFrame([(i, "w " * (50 + i % 7), ("en", "de")[i % 3 == 0], f"s{i % 4 % 3}", "t") for i in range(600)], "doc_id long, text string, lang string, source string, topic string")
    wanted = {"source": spark.createDataFrame([("s0", 0.2), ("s1", 0.5), ("s2", 0.3)], "source string, target double")}
    out = mixing.mixing(frame, share=0.3, targets=wanted).collect()
    assert max(r.margin_error for r in out) <= 1e-10
    cells = {(r.source, r.lang, r.topic): r.weight for r in out}
    for s, share in (("s0", 0.2), ("s1", 0.5), ("s2", 0.3)):
        assert sum(w for k, w in cells.items() if k[0] == s) == pytest.approx(share, abs=1e-9)
    total = sum(r.n_tokens for r in out)
    assert sum(r.p * r.n_tokens for r in out) == pytest.approx(0.3 * total, rel=1e-6)
    assert sum(r.n_tokens for r in out if r.kept) == pytest.approx(0.3 * total, rel=0.15)
    odd = mixing.mixing(docs).collect()
    assert len(odd) == len(rows()) and not any(r.kept for r in odd if r.n_tokens == 0)
    assert mixing.mixing(none).collect() == []
