"""Exact substring deduplication with suffix arrays.

A byte goes when a string of ``length`` bytes that covers it starts at another place
too; strings of ``passage`` bytes, which are shorter, are counted beside it. Equal strings
choose equal anchors: the k-gram of least hash among those inside their first ``passage``
bytes. Consecutive starts of one text that share an anchor form a context, which reaches
to the end of their longest strings, and only contexts with equal anchors can hold equal
strings. Anchors that occur once are dropped; equal contexts collapse to one with a count.

The different contexts of an anchor are cut into blocks counted from the anchor, each
different block being one integer symbol, and a suffix array (linear grouping, see
``suffix_array``) over these symbols brings together all suffixes that begin with the
same blocks. Strings whose whole blocks agree are neighbours there; the bytes at
their two ends then decide.

An anchor with more than ``hot`` different contexts is split by the string itself: a
context then is one start, so equal strings collapse to one counted context. That gives
the same result without a suffix array and without any task that holds the whole anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import discard, materialize, small_enough, text_or_empty
from marginalia.llm.suffix_array import suffix_array
from marginalia.llm.vectors import mix, runs, slices

_U = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Bytes of a block that is one symbol of a suffix array.
BLOCK = 32
#: Bytes of the contexts that one suffix array sorts, a larger anchor's apart.
BATCH = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            known = _powers[base] = np.cumprod(up), np.cumprod(down)
    return known


class Ranges:
    """64-bit hashes of arbitrary byte ranges of one buffer."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = _pow(base, len(data) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, passage: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first start, span, size, place, anchor hash, digest, left, right): runs of
    starts that share an anchor.

    A context begins at its first start, has ``span`` more, ``size`` bytes and its anchor
    at ``place``; it ends where the longest string of its last start ends, or its text.
    A string reaches at least half of what its first ``passage`` bytes have besides the
    anchor to the left or to the right of it; left and right digest the anchor with that
    much on one side. Contexts that agree in neither hold no equal strings. A side that no
    string of the context reaches has a digest of the context.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, _U, _U, _U, _U))
    n = len(data)
    if n < passage:
        return none
    ranges = Ranges(data)
    at = np.arange(n - k + 1)
    gram = ranges.of(at, at + k)
    anchor = (_sliding_min((gram & _U(0xFFFFFFFF00000000)) | at.astype(_U), passage - k + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + passage <= offsets[doc + 1]
    start, doc, anchor = start[inside], doc[inside], anchor[inside]
    if not len(start):
        return none
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(start)])) - 1
    s, e, a, d = start[first], start[last], anchor[first], doc[first]
    end = np.minimum(e + length, offsets[d + 1])
    whole = mix(ranges.of(s, end) + (a - s).astype(_U) * _U(3)) ^ mix((end - s).astype(_U) * _U(4096) + (e - s).astype(_U))
    half = (passage - k) // 2
    west, east = a - half >= s, a + k + half <= end
    left = np.where(west, ranges.of(np.maximum(a - half, 0), a + k), whole)
    right = np.where(east, ranges.of(a, np.minimum(a + k + half, n)) ^ _U(1), whole)
    return d, s - offsets[d], e - s, end - s, a - s, gram[a], whole, left >> _U(32), right >> _U(32)


_FOUND = "key long, c long, doc_id long, text_h long, at int, span int, size int, place int, left int, right int"


def _find(length: int, passage: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                d, s, span, size, place, key, c, left, right = contexts(data, offsets, length, passage, k)
                if not len(d):
                    continue
                rows = pa.array(d)
                own = [batch.column(x).slice(lo, hi - lo).take(rows) for x in ("doc_id", "text_h")]
                small = [pa.array(x.astype(np.int32)) for x in (s, span, size, place)]
                sides = [pa.array(x.astype(np.uint32).view(np.int32)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), *own, *small, *sides],
                    names=["key", "c", "doc_id", "text_h", "at", "span", "size", "place", "left", "right"],
                )

    return run


_LISTED = {"key": pa.int64(), "c": pa.int64(), "n": pa.int64(), "span": pa.int32(), "size": pa.int32(), "place": pa.int32()}
_PIECE = "key long, c long, n long, span int, size int, place int, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed contexts."""
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            raw, rows = text.as_py(), wanted.as_py()
            for lo in range(0, len(rows), 1024):
                part = rows[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([r[name] for r in part], kind) for name, kind in _LISTED.items()],
                        pa.array([raw[r["at"] : r["at"] + r["size"]] for r in part], pa.binary()),
                    ],
                    names=[*_LISTED, "bytes"],
                )


def _suffix_runs(flat: Ranges, begin: np.ndarray, size: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first symbol of each context, runs): row q of ``runs`` numbers, for every block,
    the suffixes that begin with the same q blocks."""
    lead = place % BLOCK
    count = np.maximum(size - lead, 0) // BLOCK
    symbols = count + 1
    first = np.concatenate(([0], np.cumsum(symbols)[:-1]))
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + lead[owner] + nth * BLOCK
    _, code = np.unique(flat.of(at, at + BLOCK), return_inverse=True)
    # 0 ends the text and 1 each context.
    text = np.ones(int(symbols.sum()) + 1, np.int64)
    text[-1] = 0
    text[first[owner] + nth] = code + 2
    order = np.array(suffix_array(text.tolist()), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    padded = np.concatenate((text, np.zeros(most, np.int64)))
    alike = np.ones(len(order) - 1, bool)
    runs_of = np.zeros((most + 1, len(text)), np.int64)
    for q in range(1, most + 1):
        alike &= padded[order[1:] + q - 1] == padded[order[:-1] + q - 1]
        runs_of[q] = np.concatenate(([0], np.cumsum(~alike)))[rank]
    return first, runs_of


def repeated_starts(
    strings: list[bytes], span: np.ndarray, place: np.ndarray, counts: np.ndarray, lengths: tuple[int, ...]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length, (context, start) of the starts whose string starts at another place of the
    contexts too, each context counting as ``counts`` places."""
    size = np.array([len(x) for x in strings])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    data = np.frombuffer(b"".join(strings), np.uint8)
    flat = Ranges(data)
    most = max(lengths) // BLOCK
    first, runs_of = _suffix_runs(flat, begin, size, place, most)
    lead = place % BLOCK
    out = []
    for length in lengths:
        fitting = np.maximum(np.minimum(span, size - length) + 1, 0)
        owner = np.repeat(np.arange(len(size)), fitting)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(fitting) - fitting, fitting)
        if not len(owner):
            out.append((owner, start))
            continue
        block = np.maximum(-(-(start - lead[owner]) // BLOCK), 0)
        inner = (start + length - lead[owner]) // BLOCK - block
        run = runs_of[inner, first[owner] + block]
        ends = flat.of(begin[owner] + start, begin[owner] + start + length)
        with np.errstate(over="ignore"):
            group = mix(ends ^ mix(run.astype(_U) * _U(0x9E3779B97F4A7C15) + inner.astype(_U)))
        _, group = np.unique(group, return_inverse=True)
        again = np.bincount(group, counts[owner])[group] > 1
        out.append((owner[again], start[again]))
    return out


def _intervals(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one context."""
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(start) != 1))
    lo, hi = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(owner) - 1]))
    return owner[lo], start[lo], start[hi]


_MARK = "key long, c long, whole boolean, lo int, hi int"


def _group(length: int, passage: int):
    """Marks of the repeated starts of sorted contexts, whole anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "key"):
            key, c = part["key"].to_numpy(), part["c"].to_numpy()
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
            part = part.filter(pa.array(once))
            key, c, n, span, size, place = (part[x].to_numpy() for x in _LISTED)
            edges = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) + 1
            total = np.cumsum(size)[edges - 1]
            lo = done = 0
            while lo < len(key):
                i = np.searchsorted(edges, lo, "right")
                i = max(i, int(np.searchsorted(total, done + BATCH, "right")) - 1)
                hi, done = int(edges[i]), int(total[i])
                raw = part["bytes"].slice(lo, hi - lo).to_pylist()
                lengths = (length, passage) if length > passage else (length,)
                found = repeated_starts(raw, span[lo:hi], place[lo:hi], n[lo:hi], lengths)
                for whole, (owner, start) in zip((True, False), found):
                    if len(owner):
                        of, a, b = _intervals(owner, start)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key[lo:hi][of]), pa.array(c[lo:hi][of]), pa.array(np.full(len(of), whole)),
                                pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                            ],
                            names=["key", "c", "whole", "lo", "hi"],
                        )
                lo = hi

    return run


def _single_starts(length: int, passage: int):
    """(key, c, n, whole, lo, s1, s2): every start of the given contexts with a digest of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)
                hashes = [Ranges(data, b) for b in BASES]
                for whole, size in ((True, length), (False, passage)):
                    at = np.arange(min(batch.column("span")[i].as_py(), len(data) - size) + 1)
                    if len(at) and (whole or passage < length):
                        s1, s2 = (pa.array(h.of(at, at + size).view(np.int64)) for h in hashes)
                        same = [pa.array(np.full(len(at), batch.column(x)[i].as_py(), np.int64)) for x in ("key", "c", "n")]
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(np.full(len(at), whole)), pa.array(at.astype(np.int32)), s1, s2],
                            names=["key", "c", "n", "whole", "lo", "s1", "s2"],
                        )

    return run


def _counted_sides(distinct: DataFrame, side: str) -> DataFrame:
    """(key, side): sides that several different contexts of an anchor share."""
    met = distinct.groupBy("key", side).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return met.select(F.col("key").alias(f"_k_{side}"), F.col(side).alias(f"_{side}"))


def repeated_intervals(docs: DataFrame, length: int, passage: int, k: int, hot: int) -> DataFrame:
    """(doc_id, text_h, whole, start, end): byte intervals that repeated strings cover; they
    may overlap. ``whole`` tells strings of ``length`` bytes from those of ``passage``."""
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_h"), text_or_empty().cast("binary").alias("text"))
    long = texts.where(F.octet_length("text") >= passage)
    found = materialize(long.mapInArrow(_find(length, passage, k), _FOUND), "contexts")
    # Written first, so that the join below can split the rows of a frequent anchor.
    repeated = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-anchors")
    live = materialize(found.join(repeated, "key", "left_semi"), "live-contexts")
    discard(found, repeated)
    same = ["key", "c"]
    distinct = materialize(
        live.groupBy(*same).agg(
            F.count(F.lit(1)).alias("n"), F.min("span").alias("span"), F.min("size").alias("size"), F.min("place").alias("place"),
            F.min("left").alias("left"), F.min("right").alias("right"), F.min(F.struct("text_h", "at", "doc_id")).alias("of"),
        ),
        "distinct-contexts",
    )
    keys = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # Nothing is left to decide where all contexts are counted twice.
    open_keys = keys.where("kinds > 1 AND least = 1").select("key", (F.col("kinds") > hot).alias("hot"))
    todo = distinct.join(open_keys, "key")
    for side in ("left", "right"):
        met = _counted_sides(distinct, side)
        todo = todo.join(met, (todo["key"] == met[f"_k_{side}"]) & (todo[side] == met[f"_{side}"]), "left")
    todo = todo.where("_k_left IS NOT NULL OR _k_right IS NOT NULL")
    listed = F.struct(*same, "n", "span", "size", "place", F.col("of.at").alias("at"))
    wanted = todo.groupBy(F.col("of.doc_id").alias("_d"), F.col("of.text_h").alias("_h")).agg(F.collect_list(listed).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    joined = long.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_h") == F.col("_h")))
    pieces = materialize(joined.select("text", "wanted").mapInArrow(_cut, _PIECE), "pieces")
    hot_keys = open_keys.where("hot").select("key")
    cold = pieces.join(hot_keys, "key", "left_anti").repartition("key").sortWithinPartitions("key", "c")
    partial = cold.mapInArrow(_group(length, passage), _MARK)
    starts = pieces.join(hot_keys, "key", "left_semi").dropDuplicates(same).select(*same, "n", "span", "bytes").mapInArrow(
        _single_starts(length, passage), "key long, c long, n long, whole boolean, lo int, s1 long, s2 long"
    )
    strings = starts.groupBy("s1", "s2", "whole").agg(F.sum("n").alias("places")).where("places > 1")
    single = starts.join(strings, ["s1", "s2", "whole"]).select(*same, "whole", "lo", F.col("lo").alias("hi"))
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("whole")
    reach = F.least("span", F.col("size") - F.when(F.col("whole"), length).otherwise(passage))
    counted = distinct.where("n > 1").select(*same, both, "span", "size").select(*same, "whole", F.lit(0).alias("lo"), reach.alias("hi"))
    marks = materialize(partial.unionByName(single).unionByName(counted.where("hi >= 0")), "marks")
    discard(pieces, wanted, distinct)
    width = F.when(F.col("whole"), length).otherwise(passage)
    out = materialize(
        live.join(marks, same).select(
            "doc_id", "text_h", "whole", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + width).alias("end")
        ),
        "intervals",
    )
    discard(live, marks)
    return out


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals that overlap or touch become one, by (doc_id, text_h, whole)."""
    by = ["doc_id", "text_h", "whole"]
    ordered = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = intervals.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = apart.withColumn("island", F.sum("fresh").over(ordered))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


@F.pandas_udf(T.BinaryType())
def _remove(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(raw, listed):
        if raw is None:
            return None
        kept, last = [], 0
        for s in listed:
            kept.append(raw[last : s["start"]])
            last = s["end"]
        return b"".join([*kept, raw[last:]])

    return pd.Series([cut(raw, listed) for raw, listed in zip(text, spans, strict=True)], dtype=object)


def dedup_suffixes(docs: DataFrame, length: int = 400, passage: int = 224, k: int = 32, hot: int = 16_384) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated,
    kept (bytes).

    Texts are UTF-8 bytes, null is empty; strings are judged on the input and never cross
    documents. ``n_repeated`` counts the bytes that a string of ``passage`` bytes covers which
    starts at another place too; they stay. Every row is a document, so repeated rows repeat
    each other; rows with a null doc_id take part.
    """
    spans = merged_intervals(repeated_intervals(docs, length, passage, k, hot))
    covered = F.col("end") - F.col("start")
    gone = F.when(F.col("whole"), F.struct("start", "end"))
    per_doc = materialize(
        spans.groupBy("doc_id", "text_h").agg(
            F.sum(F.when(F.col("whole"), covered).otherwise(0)).alias("removed"), F.count_if("whole").alias("runs"),
            F.sum(F.when(F.col("whole"), 0).otherwise(covered)).alias("repeated"), F.array_sort(F.collect_list(gone)).alias("spans"),
        ),
        "spans",
    ).withColumnsRenamed({"doc_id": "_d", "text_h": "_h"})
    small = small_enough(per_doc, size_of=48 * F.size("spans") + 96)
    per_doc = F.broadcast(per_doc) if small else per_doc
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_h"), text_or_empty().cast("binary").alias("text"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_h") == F.col("_h")), "left")
    hit = F.coalesce(F.col("runs") > 0, F.lit(False))
    done = joined.select(
        "doc_id", F.col("text"), hit.alias("hit"), "removed", "runs", "repeated",
        _remove(F.when(hit, F.col("text")), F.col("spans")).alias("left_over"),
    )
    kept = F.when(F.col("hit"), F.col("left_over")).otherwise(F.col("text"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return done.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        number("removed").alias("n_removed"),
        number("runs").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
        # Where both lengths are the same only the longer is marked.
        (number("repeated") if passage < length else number("removed")).alias("n_repeated"),
        kept.alias("kept"),
    )
