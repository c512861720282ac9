"""Language-model scoring by cross-entropy difference.

Two bigram models of words, one of the target documents and one of the others, are
counted over every document of the corpus and share one vocabulary. A word is told apart
by what stands before it: one of the most frequent words, or the symbol for all others.
The bigrams of frequent words that occur most are counted by one aggregation and scored
where the texts are; every other bigram, however rare, travels in packed form to the
bucket of its hash and is counted and scored there. Both models are smoothed alike, a
bigram backing off to its word. A document's own counts are left out of the model that
holds them when it is scored. Its score is the mean over its words of loss under the
target minus loss under the background: the lower, the more it is like the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_broadcast, discard, materialize, text_or_empty
from marginalia.llm.vectors import mix, runs, slices, word_hashes

#: Most words with a count of their own, and most bigrams that are scored without a bucket.
MAX_WORDS, MAX_GRAMS = 32_768, 1_000_000
#: Words of the corpus to a bucket.
BUCKET = 1 << 22
#: Bigrams that a task computes or returns at once, and words that it counts at once.
STEP, COUNTED = 1 << 18, 1 << 19
#: Pseudo-count with which a bigram trusts its word, and a word the uniform distribution.
BACKOFF = 4.0
#: Packed columns of a bucket: by document, then by different bigram of a document.
PACKED = {"id": "<i8", "h": "<i8", "length": "<i8", "size": "<i4", "gram": "<u8", "symbol": "<i4", "own": "<i4", "n": "<i4"}
#: Packed columns of what a bucket adds to the documents of a piece of texts.
SUMS = {"id": "<i8", "h": "<i8", "more_target": "<f8", "more_background": "<f8"}


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The parts joined to stretches of about COUNTED values, so that sorting one takes little."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= COUNTED:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in _gathered(word_hashes(data, offsets)[1] for _, _, data, offsets in slices(batch, "text")):
            word, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def _rounded(n: Column) -> Column:
    """A count with its binary digits after the fourth cleared: few different values."""
    scale = F.pow(F.lit(2), F.greatest(F.length(F.bin(n)) - 4, F.lit(0))).cast("long")
    return n - n % scale


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` (n) from the least count on that leaves at most ``most`` of them."""
    sizes = counts.groupBy(_rounded(F.col("n")).alias("from")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("from")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["rows"]
        if total > most:
            break
        least = r["from"]
    return counts.where(F.col("n") >= least) if least is not None else counts.where("false")


def _symbols(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, symbol, symbol before it, bigram hash) of every word. ``words`` is sorted;
    symbol len(words) is any other word, the next one stands before a text."""
    doc, word = word_hashes(data, offsets)
    at = np.searchsorted(words, word)
    known = np.zeros(len(word), bool)
    if len(words):
        known = words[np.minimum(at, len(words) - 1)] == word
    now = np.where(known, at, len(words))
    before = np.concatenate((np.zeros(1, np.int64), now[:-1]))[: len(now)]
    if len(now):
        before[np.concatenate(([True], doc[1:] != doc[:-1]))] = len(words) + 1
    with np.errstate(over="ignore"):
        gram = mix(word + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc, now, before, gram


def _own(doc: np.ndarray, symbol: np.ndarray, width: int) -> np.ndarray:
    """How often the document of every word has its symbol."""
    if not len(doc):
        return np.zeros(0, np.int64)
    _, group = np.unique(doc * np.int64(width) + symbol, return_inverse=True)
    return np.bincount(group)[group]


def _gram_counts(words: np.ndarray):
    width = len(words) + 2

    def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        wanted = batch.column("target").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in slices(batch, "text"):
            doc, now, before, _ = _symbols(data, offsets, words)
            yield (before * width + now) * 2 + wanted[lo:hi][doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _gathered(codes(batch)):
                code, n = np.unique(some, return_counts=True)
                for at in range(0, len(code), STEP):
                    c, k = code[at : at + STEP], n[at : at + STEP]
                    good = c & 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c >> 1), pa.array(np.where(good, k, 0)), pa.array(np.where(good, 0, k))],
                        names=["gram", "n_target", "n_background"],
                    )

    return run


class Models:
    """Both models as dense arrays by symbol and sorted arrays of the frequent bigrams.

    ``others`` is the number of different words without a symbol of their own.
    """

    def __init__(self, words: np.ndarray, others: int, unigrams: np.ndarray, contexts: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.words, self.others, self.width = words, others, len(words) + 2
        self.unigrams, self.contexts, self.grams, self.counts = unigrams, contexts, grams, counts
        self.totals = unigrams.sum(axis=1)

    def place(self, now: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent bigrams, whether it is one) of every word."""
        code = before * self.width + now
        if not len(self.grams):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        return at, self.grams[at] == code

    def word(self, m: int, symbol: np.ndarray, own: np.ndarray, length: np.ndarray, left: np.ndarray) -> np.ndarray:
        """p(w) = (n(w) + k / V) / (N + k) by symbol, V being the number of symbols of a
        text; the words without a symbol share theirs equally."""
        p = (self.unigrams[m][symbol] - own * left + BACKOFF / (self.width - 1)) / (self.totals[m] - length * left + BACKOFF)
        return np.where(symbol == len(self.words), p / max(self.others, 1), p)

    def losses(self, doc: np.ndarray, now: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Bits of every word under both models, each without the word's own document.

        p(w | v) = (n(v w) + k p(w)) / (n(v) + k). Here n(v w) is 0 for a bigram that is
        not among the frequent ones; its bucket adds the difference.
        """
        place, kept = self.place(now, before)
        length = np.bincount(doc, minlength=doc.max() + 1 if len(doc) else 0)[doc]
        single, context, pair = _own(doc, now, self.width), _own(doc, before, self.width), np.zeros(len(doc), np.int64)
        pair[kept] = _own(doc[kept], place[kept], len(self.grams))
        out = np.empty((2, len(doc)))
        for m in range(2):
            left = target[doc] == (m == 0)
            both = (self.counts[m][place] if len(self.grams) else 0) * kept - pair * left
            p = (both + BACKOFF * self.word(m, now, single, length, left)) / (self.contexts[m][before] - context * left + BACKOFF)
            out[m] = -np.log2(p)
        return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in slices(batch, "text"):
                doc, now, before, _ = _symbols(data, offsets, models.words)
                bits = models.losses(doc, now, before, target[lo:hi])
                sums = [np.bincount(doc, b, hi - lo).astype(float) for b in bits]
                same = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "id", "h")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(np.bincount(doc, minlength=hi - lo)), *map(pa.array, sums)],
                    names=["doc_id", "id", "h", "n_tokens", "bits_target", "bits_background"],
                )

    return run


def _packed(values: np.ndarray, bounds: np.ndarray, kind: str) -> pa.Array:
    """Binary values, one for each stretch between ``bounds``."""
    raw = np.ascontiguousarray(values, kind)
    ends = (bounds * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns differs from the value before."""
    fresh = np.ones(len(columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _rare(shared, buckets: int):
    """One row per piece of texts and bucket: the bigrams that are not among the frequent
    ones, once per document, with what their loss depends on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        for batch in batches:
            target, ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("target", "id", "h"))
            for lo, hi, data, offsets in slices(batch, "text"):
                doc, now, before, gram = _symbols(data, offsets, models.words)
                rare = ~models.place(now, before)[1]
                if not rare.any():
                    continue
                length = np.bincount(doc, minlength=hi - lo) * 2 + target[lo:hi]
                columns = doc[rare], gram[rare], now[rare], _own(doc, now, models.width)[rare]
                bucket = (columns[1] >> np.uint64(20)) % np.uint64(buckets)
                order = np.lexsort((columns[1], columns[0], bucket))
                doc, gram, now, own, bucket = (c[order] for c in (*columns, bucket))
                first = _starts(doc, gram)
                n = np.diff(np.append(first, len(doc)))
                doc, gram, now, own, bucket = (c[first] for c in (doc, gram, now, own, bucket))
                group, row = _starts(bucket, doc), _starts(bucket)
                by_gram = np.append(row, len(doc))
                by_doc = np.searchsorted(group, by_gram)
                who = doc[group]
                values = {
                    "id": ids[lo:hi][who], "h": hashes[lo:hi][who], "length": length[who], "size": np.diff(np.append(group, len(doc))),
                    "gram": gram, "symbol": now, "own": own, "n": n,
                }
                packed = [_packed(values[c], by_doc if i < 4 else by_gram, kind) for i, (c, kind) in enumerate(PACKED.items())]
                piece = np.full(len(row), hashes[lo:hi].sum())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[row].astype(np.int64)), pa.array(piece), *packed], names=["bucket", "piece", *PACKED])

    return run


def dealt(rare: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket in a partition of their own: a hash of the number would bring several
    into one, which reach a worker as one batch, and would leave other partitions empty."""
    return rare.repartitionById(buckets, F.col("bucket").cast("int"))


def _add_bits(models: Models, bits: np.ndarray, at: np.ndarray, sizes: np.ndarray, doc: np.ndarray, good: np.ndarray, c: dict[str, np.ndarray]) -> None:
    """Add to ``bits`` of both models what the entries ``at`` bring; they are those of whole
    bigrams of ``sizes`` entries, ``doc`` is the document of every entry."""
    group, n = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), c["n"][at]
    counts = [np.bincount(group, n * (good[doc[at]] == (m == 0)), len(sizes)) for m in range(2)]
    met = np.flatnonzero((counts[0] + counts[1])[group] > n)
    at, group, n = at[met], group[met], n[met]
    who, symbol, own = doc[at], c["symbol"][at], c["own"][at]
    for m in range(2):
        left = good[who] == (m == 0)
        word = models.word(m, symbol, own, (c["length"] >> 1)[who], left)
        bits[m] += np.bincount(who, -n * np.log2(1 + (counts[m][group] - n * left) / (BACKOFF * word)), len(good))


def _corrections(shared):
    """Bits that the counts of a bucket's bigrams add to the losses of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        for table in runs(batches, "bucket"):
            rows = np.array([len(b) // 8 for b in table.column("id").to_pylist()])
            bucket = np.repeat(table.column("bucket").to_numpy(), rows)
            c = {k: np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in PACKED.items()}
            piece = table.column("piece")
            del table
            order = np.argsort(c["gram"], kind="stable").astype(np.int32)
            ends = np.append(_starts(c.pop("gram")[order]), len(order))
            doc = np.repeat(np.arange(len(c["id"]), dtype=np.int32), c["size"])
            good = (c["length"] & 1).astype(bool)
            bits = np.zeros((2, len(good)))
            # Whole bigrams of about STEP entries at once; a more frequent one is alone.
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(order), STEP)), len(ends) - 1))
            for lo, hi in zip(cuts, cuts[1:]):
                _add_bits(models, bits, order[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1]), doc, good, c)
            del order, doc
            for k in ("n", "symbol", "own"):
                c.pop(k)
            # Repeated rows bring the same bits; one of them stands for all.
            order = np.lexsort((c["h"], c["id"], bucket))
            one = order[_starts(bucket[order], c["id"][order], c["h"][order])]
            one = np.sort(one[(bits[0][one] != 0) | (bits[1][one] != 0)])
            bounds = np.searchsorted(one, np.concatenate(([0], np.cumsum(rows))))
            sums = [_packed(x[one], bounds, kind) for x, kind in zip((c["id"], c["h"], *bits), SUMS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.combine_chunks(), *sums], names=["piece", *SUMS])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a piece: what all buckets add to its losses."""
    for table in runs(batches, "piece"):
        c = {k: np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in SUMS.items()}
        order = np.lexsort((c["h"], c["id"]))
        first = _starts(c["id"][order], c["h"][order])
        bits = [np.add.reduceat(c[k][order], first) if len(first) else np.zeros(0) for k in ("more_target", "more_background")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["id"][order][first], c["h"][order][first], *bits)], names=list(SUMS))


def _sorted_columns(df: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    got = df.select(key, *values).toArrow()
    columns = [got[c].to_numpy() for c in (key, *values)]
    order = np.argsort(columns[0].view(np.uint64) if key == "word" else columns[0])
    return [c[order] for c in columns]


def _by_symbol(grams: DataFrame, symbol: Column, width: int) -> np.ndarray:
    out = np.zeros((2, width))
    for r in grams.groupBy(symbol.cast("long").alias("s")).agg(F.sum("n_target").alias("t"), F.sum("n_background").alias("b")).toArrow().to_pylist():
        out[:, r["s"]] = r["t"], r["b"]
    return out


def train(marked: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Models:
    """Models of the rows of ``marked`` (text binary, target int), counted over all of them."""
    words = materialize(marked.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    vocabulary = _sorted_columns(frequent(words, max_words), "word")[0].view(np.uint64)
    others = words.count() - len(vocabulary)
    counted = marked.mapInArrow(_gram_counts(vocabulary), "gram long, n_target long, n_background long")
    grams = materialize(counted.groupBy("gram").agg(F.sum("n_target").alias("n_target"), F.sum("n_background").alias("n_background")), "grams")
    discard(words)
    width = len(vocabulary) + 2
    unigrams = _by_symbol(grams, F.col("gram") % width, width)
    contexts = _by_symbol(grams, F.floor(F.col("gram") / width), width)
    # Bigrams that end in a word without a symbol are told apart by the word, in buckets.
    named = grams.where(F.col("gram") % width < len(vocabulary)).withColumn("n", F.col("n_target") + F.col("n_background"))
    gram, t, b = _sorted_columns(frequent(named, max_grams), "gram", "n_target", "n_background")
    discard(grams)
    return Models(vocabulary, others, unigrams, contexts, gram, np.array([t, b], np.float64).reshape(2, -1))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, loss_target, loss_background, score.

    ``target`` lists the doc_ids of the target documents; all other rows, those with a
    null doc_id too, are background. Tokens are whitespace-separated words as they are; losses
    are mean bits per token. Null and empty texts score 0. Without target documents its
    model is uniform. Repeated rows count as often as they occur; a row leaves out itself only.

    All words and all bigrams of all documents are counted and all of them score. The
    executors get the at most ``max_words`` most frequent words, which are the contexts that
    are told apart, and the at most ``max_grams`` most frequent bigrams, those that would make a
    bucket large; where a bigram is counted does not change its loss. The number of buckets
    follows the number of words.
    """
    ids = target.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_t")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keys = F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("h")
    marked = rows.join(bounded_broadcast(ids), F.col("doc_id") == F.col("_t"), "left").select(
        "doc_id", *keys, F.col("text").cast("binary").alias("text"), F.col("_t").isNotNull().cast("int").alias("target")
    )
    models = train(marked.select("text", "target"), max_words, max_grams)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    scored = marked.mapInArrow(_score(shared), "doc_id long, id long, h long, n_tokens long, bits_target double, bits_background double")
    buckets = int(models.totals.sum()) // BUCKET + 1
    kinds = ", ".join(f"{c} binary" for c in PACKED)
    rare = marked.select("id", "h", "text", "target").mapInArrow(_rare(shared, buckets), f"bucket long, piece long, {kinds}")
    parts = dealt(rare, buckets).mapInArrow(_corrections(shared), "piece long, " + ", ".join(f"{c} binary" for c in SUMS))
    # A piece is a few thousand documents, so their sums need little memory. Pieces only bring
    # parts together; documents are told apart by id and text.
    pieces = parts.repartition("piece").sortWithinPartitions("piece")
    more = pieces.mapInArrow(_summed, "id long, h long, more_target double, more_background double")
    more = more.groupBy("id", "h").agg(F.sum("more_target").alias("more_target"), F.sum("more_background").alias("more_background"))
    each = scored.join(more, ["id", "h"], "left")
    loss = lambda m: F.coalesce((F.col(f"bits_{m}") + F.coalesce(f"more_{m}", F.lit(0.0))) / F.nullif("n_tokens", F.lit(0)), F.lit(0.0))
    out = each.select("doc_id", "n_tokens", loss("target").alias("loss_target"), loss("background").alias("loss_background"))
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
