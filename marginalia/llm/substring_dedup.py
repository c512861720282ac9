"""Substring deduplication by content-defined cuts.

A gear rolling hash over the last 32 bytes cuts each text at the least value of every
97 positions, so cuts depend on nearby bytes only and any 128 bytes that two places
share hold a common cut. The 32 bytes before a cut are only a seed: places with equal
seeds compare the bytes around it and every match is extended byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialize, text_or_empty
from marginalia.llm.suffix_dedup import BASES, Ranges
from marginalia.llm.vectors import mix, slices

#: Bytes that a cut depends on; also the least chunk.
REACH = 32


def gear_table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)


def gear_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last 32 bytes, by doubling."""
    h = gear[data]
    width = 1
    while width < REACH:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, gear: np.ndarray, bits: int, longest: int) -> tuple[list[int], list[int]]:
    """(ends, documents) of the chunks; texts are cut apart, chunks have 32 to ``longest``
    bytes, but for the last of a text."""
    wanted = np.flatnonzero((gear_hash(data, gear) & np.uint32((1 << bits) - 1)) == 0) + 1
    owner = np.searchsorted(offsets, wanted, "left") - 1
    ends, docs = [], []
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    cuts = wanted.tolist()
    for d in range(len(offsets) - 1):
        last, stop = int(offsets[d]), int(offsets[d + 1])
        for p in [*cuts[bounds[d] : bounds[d + 1]], stop]:
            while p - last > longest:
                last += longest
                ends.append(last)
                docs.append(d)
            if p - last >= REACH or (p == stop and p > last):
                ends.append(p)
                docs.append(d)
                last = p
    return ends, docs


def anchors(data: np.ndarray, offsets: np.ndarray, gear: np.ndarray, span: int) -> np.ndarray:
    """Ends of the seeds: the last least hash of every ``span`` bytes inside one text."""
    if len(data) < span:
        return np.zeros(0, np.int64)
    width, full = span - REACH + 1, (1 << 32) - 1
    low = (gear_hash(data, gear).astype(np.int64) << 31) | (full >> 1) - np.arange(len(data))
    wide = 1
    while wide < width:
        step = min(wide, width - wide)
        low[step:] = np.minimum(low[step:], low[:-step])
        wide += step
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.unique((full >> 1) - (low[at >= span - 1] & (full >> 1))) + 1


def _seeds(span: int):
    gear = gear_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_h"))
            for lo, hi, data, offsets in slices(batch, "text"):
                end = anchors(data, offsets, gear, span)
                if not len(end):
                    continue
                raw, doc = data.tobytes(), np.searchsorted(offsets, end, "left") - 1
                digest = b"".join(hashlib.blake2b(raw[e - REACH : e], digest_size=8).digest() for e in end.tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(digest, "<i8")), pa.array(ids[lo:hi][doc].astype(np.int64)),
                        pa.array(hashes[lo:hi][doc]), pa.array((end - offsets[doc]).astype(np.int32)),
                    ],
                    names=["d", "doc_id", "text_h", "at"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_h"), text_or_empty().cast("binary").alias("text")
    )


def seeds(docs: DataFrame, span: int) -> DataFrame:
    """(d, doc_id, text_h, at): a 64-bit digest of the 32 bytes before every cut, and the cut."""
    return _texts(docs).mapInArrow(_seeds(span), "d long, doc_id long, text_h long, at int")


_KEY = ["k1", "k2"]
_WINDOW = "k1 long, k2 int, c long, doc_id long, text_h long, s int, before int, after int"


def _windows(span: int):
    """Two places that share ``span`` bytes around a seed share half of the rest of them
    on its left or on its right: those windows are compared, with as much on either side,
    which reaches the next cut or the end of what is shared. ``k1`` and ``k2`` digest a
    window, ``c`` the window with the ``before`` and ``after`` bytes beside it."""
    half = (span - REACH) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                cuts = batch.column("cuts").slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), pc.list_value_length(cuts).to_numpy())
                end = offsets[doc] + cuts.flatten().to_numpy()
                one, two = (Ranges(data, b) for b in BASES)
                for side, start in ((0, end - REACH - half), (1, end - REACH)):
                    inside = (start >= offsets[doc]) & (start + REACH + half <= offsets[doc + 1])
                    of, s = doc[inside], start[inside]
                    t = s + REACH + half
                    before, after = np.minimum(s - offsets[of], half), np.minimum(offsets[of + 1] - t, half)
                    sides = np.uint64(side)
                    with np.errstate(over="ignore"):
                        k1, k2 = mix(one.of(s, t) + sides), two.of(s, t) >> np.uint64(32)
                        beside = (before * 4096 + after).astype(np.uint64) * np.uint64(2) + sides
                        c = mix(two.of(s - before, t + after) ^ mix(beside))
                    rows = pa.array(of)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1.view(np.int64)), pa.array(k2.astype(np.uint32).view(np.int32)), pa.array(c.view(np.int64)),
                            *[batch.column(x).slice(lo, hi - lo).take(rows) for x in ("doc_id", "text_h")],
                            *[pa.array(x.astype(np.int32)) for x in (s - offsets[of], before, after)],
                        ],
                        names=["k1", "k2", "c", "doc_id", "text_h", "s", "before", "after"],
                    )

    return run


def _surroundings(width: int):
    """(k1, k2, c, pre, post): the bytes before a window, last one first, and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw, rows = text.as_py(), wanted.as_py()
                for lo in range(0, len(rows), 1024):
                    part = rows[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["k1"] for r in part], pa.int64()), pa.array([r["k2"] for r in part], pa.int32()), pa.array([r["c"] for r in part], pa.int64()),
                            pa.array([raw[r["s"] - r["before"] : r["s"]][::-1] for r in part], pa.binary()),
                            pa.array([raw[r["s"] + width : r["s"] + width + r["after"]] for r in part], pa.binary()),
                        ],
                        names=["k1", "k2", "c", "pre", "post"],
                    )

    return run


def _alike(a: bytes, b: bytes | None) -> int:
    """Length of the common prefix."""
    if b is None:
        return 0
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far each context agrees with its neighbours in order, to the left and to the right."""
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("pre", "pre_1", "pre_2", "post", "post_1", "post_2")}
        left = [max(_alike(a, x), _alike(a, y)) for a, x, y in zip(c["pre"], c["pre_1"], c["pre_2"], strict=True)]
        right = [max(_alike(a, x), _alike(a, y)) for a, x, y in zip(c["post"], c["post_1"], c["post_2"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(x) for x in (*_KEY, "c")], pa.array(left, pa.int32()), pa.array(right, pa.int32())],
            names=[*_KEY, "c", "left", "right"],
        )


def equal_pieces(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, text_h, lo, hi, f_doc, moved): pieces of texts that occur at another place too.

    Their union holds every span of at least ``span`` bytes that occurs twice. Windows with
    equal bytes on either side are one context; only the different contexts of a window
    are compared, and in sorted order the neighbours of a context share the longest bytes
    with it. ``f_doc`` is the document of the least (doc_id, text_h, offset) of the piece,
    ``moved`` false for that place. Each step is written, so that its shuffles can go.
    """
    texts, document = _texts(docs), ["doc_id", "text_h"]
    # Equal digests only propose: windows are compared by 96 bits. The frequent ones are
    # written first, so that the join can split the rows of a very frequent one.
    found = materialize(seeds(docs, span), "seeds")
    again = materialize(found.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d"), "frequent-seeds")
    cuts = found.join(again, "d", "left_semi").groupBy(*document).agg(F.collect_set("at").alias("cuts"))
    cuts = materialize(cuts, "cuts")
    discard(found, again)
    windows = materialize(texts.join(cuts, document).select(*document, "text", "cuts").mapInArrow(_windows(span), _WINDOW), "windows")
    discard(cuts)
    place = F.struct(*document, "s")
    contexts = windows.groupBy(*_KEY, "c").agg(
        F.min(place).alias("of"), F.max(place).alias("last"), F.min("before").alias("before"), F.min("after").alias("after")
    )
    contexts = materialize(contexts.withColumn("many", F.col("of") != F.col("last")).drop("last"), "window-contexts")
    keys = contexts.groupBy(*_KEY).agg(F.min("of").alias("first"), F.max("many").alias("any"), F.count(F.lit(1)).alias("kinds"))
    keys = materialize(keys.where("any OR kinds > 1"), "window-keys")
    asked = contexts.join(keys.where("kinds > 1").select(*_KEY), _KEY).select(F.col("of.doc_id").alias("doc_id"), F.col("of.text_h").alias("text_h"), F.struct(*_KEY, "c", F.col("of.s").alias("s"), "before", "after").alias("w"))
    wanted = materialize(asked.groupBy(*document).agg(F.collect_list("w").alias("wanted")), "window-places")
    width = REACH + (span - REACH) // 2
    # A text whose rows repeat is cut once.
    beside = materialize(
        texts.join(wanted, document).select("text", "wanted").mapInArrow(_surroundings(width), "k1 long, k2 int, c long, pre binary, post binary"), "surroundings"
    )
    whole = Window.partitionBy(*_KEY)
    near = {"pre": whole.orderBy("pre", "c"), "post": whole.orderBy("post", "c")}
    one = beside.repartition(*_KEY).dropDuplicates([*_KEY, "c"])
    ordered = one.select(*_KEY, "c", "pre", "post", *[f(x).over(w).alias(f"{x}_{i}") for x, w in near.items() for i, f in ((1, F.lag), (2, F.lead))])
    alike = ordered.mapInArrow(_extended, "k1 long, k2 int, c long, left int, right int")
    marked = contexts.join(keys.select(*_KEY, "first"), _KEY).join(alike, [*_KEY, "c"], "left")
    reach = lambda full, own: F.when(F.col("many"), F.col(full)).otherwise(F.coalesce(own, F.lit(0)))
    marks = materialize(marked.select(*_KEY, "c", "first", reach("before", "left").alias("left"), reach("after", "right").alias("right")), "window-marks")
    discard(contexts, keys, wanted, beside)
    # Rows that repeat a document repeat its pieces, which does the spans no harm.
    pieces = windows.join(marks, [*_KEY, "c"]).select(
        *document, (F.col("s") - F.col("left")).alias("lo"), (F.col("s") + width + F.col("right")).alias("hi"), F.col("first.doc_id").alias("f_doc"),
        (F.col("first") != place).alias("moved"),
    )
    pieces = materialize(pieces, "pieces")
    discard(windows, marks)
    return pieces


def short_copies(docs: DataFrame, span: int) -> DataFrame:
    """Rows as of ``equal_pieces``: whole texts under ``span`` bytes that another document equals."""
    short = _texts(docs).where(F.octet_length("text").between(1, span - 1)).distinct()
    first = short.groupBy("text").agg(F.min("doc_id").alias("f_doc"), F.max("doc_id").alias("l_doc")).where("f_doc <> l_doc")
    return short.join(first, "text").select(
        "doc_id", "text_h", F.lit(0).alias("lo"), F.octet_length("text").alias("hi"), "f_doc", (F.col("f_doc") != F.col("doc_id")).alias("moved")
    )


def repeated_spans(docs: DataFrame, min_span: int = 128) -> DataFrame:
    """(doc_id, text_h, start, end, n_removed, first_docs): maximal repeated spans, in bytes.

    Pieces that occur at another place are joined where they meet; all but the place
    with the least (doc_id, offset) are removed: ``n_removed`` bytes of the span.
    ``first_docs`` lists the documents that keep them. Spans under ``min_span`` bytes
    stay as they are, but for whole texts that another document equals.
    """
    found = equal_pieces(docs, min_span).withColumn("least", F.lit(min_span))
    pieces = found.unionByName(short_copies(docs, min_span).withColumn("least", F.lit(1)))
    ordered = Window.partitionBy("doc_id", "text_h").orderBy("lo", "hi", "f_doc", "moved")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    past, gone = F.max("hi").over(before), F.max(F.when(F.col("moved"), F.col("hi"))).over(before)
    fresh = F.coalesce(past < F.col("lo"), F.lit(True)).cast("int")
    more = F.greatest(F.col("hi") - F.greatest("lo", F.coalesce(gone, F.col("lo"))), F.lit(0))
    numbered = pieces.withColumns({"fresh": fresh, "more": F.when(F.col("moved"), more).otherwise(0)})
    return (
        numbered.withColumn("span", F.sum("fresh").over(ordered)).groupBy("doc_id", "text_h", "span")
        .agg(
            F.min("lo").alias("start"), F.max("hi").alias("end"), F.sum("more").alias("n_removed"),
            F.sort_array(F.collect_set("f_doc")).alias("first_docs"), F.min("least").alias("least"),
        )
        .where(F.col("end") - F.col("start") >= F.col("least"))
        .drop("span", "least")
    )


def dedup_substrings(docs: DataFrame, min_span: int = 128) -> DataFrame:
    """One row per document with a repeated span: doc_id, n_spans, n_repeat_bytes,
    n_removed_bytes, first_docs.

    Documents without one are not listed, nor are null and empty texts. Fully repeated
    rows are one document: they do not repeat each other. Rows that share a doc_id but not
    a text are documents of their own, with a row each. Rows with a null doc_id take no part.
    """
    spans = repeated_spans(docs, min_span)
    return spans.groupBy("doc_id", "text_h").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_repeat_bytes"),
        F.sum("n_removed").cast("long").alias("n_removed_bytes"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("first_docs")))).alias("first_docs"),
    ).drop("text_h")
