"""Line deduplication by range-partitioned hashes with a secondary sort.

Lines become (hash, document, position) rows; texts never move for the search.
Rows are range-partitioned on (hash, document) and sorted within partitions, so a
line that a third of the corpus shares is spread over many partitions. One
streaming pass per partition decides every key run that lies inside it; runs that
touch a partition border (at most two per partition) are decided by a small second
aggregation. The result is one compressed keep bitmap per changed document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import ascii_lower, materialize, small_enough, text_or_empty

_ROW = "h1 long, h2 long, doc_id long, text_h long, pos int"
_COLS = ["h1", "h2", "doc_id", "text_h", "pos"]


def _id(doc_id: Column) -> Column:
    """A null doc_id is one document, less than all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def line_key(line: Column) -> Column:
    """Whitespace U+0009..U+000D and U+0020 stripped at both ends, A-Z lowered."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_h, pos) of every line whose key has ``min_chars`` code points.

    The two 64-bit hashes use different seeds, so equal pairs mean equal keys.
    """
    lines = docs.select(
        _id(F.col("doc_id")).alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("text_h"),
        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc_id", "text_h", "pos"
    )


def _stream(min_docs: int):
    """Decide the key runs of one sorted partition.

    Yields the rows to drop, and with ``pending`` set all rows of the first and the
    last run, whose key may continue in a neighbouring partition.
    """

    def emit(cols: list[np.ndarray], pending: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in cols] + [pa.array(np.full(len(cols[0]), pending))], names=[*_COLS, "pending"]
        )

    def decided(cols: list[np.ndarray]) -> list[np.ndarray]:
        h1, h2, doc = cols[0], cols[1], cols[2]
        new_key = np.ones(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        starts = np.flatnonzero(new_key)
        run = np.cumsum(new_key) - 1
        n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        drop = (n_docs[run] >= min_docs) & (doc != doc[starts][run])
        return [c[drop] for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        first: tuple[int, int] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _COLS]
            if not len(cols[0]):
                continue
            if first is None:
                first = (cols[0][0], cols[1][0])
            if held is None:
                border = (cols[0] == first[0]) & (cols[1] == first[1])
                if border.any():
                    yield emit([c[border] for c in cols], True)
                    cols = [c[~border] for c in cols]
                if not len(cols[0]):
                    continue
            else:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(last) - int(last.sum())
            if cut:
                yield emit(decided([c[:cut] for c in cols]), False)
            held = [c[cut:] for c in cols]
        if held is not None:
            yield emit(held, True)

    return run


@F.pandas_udf(T.BinaryType())
def _pack(dropped: pd.Series) -> pd.Series:
    def pack(positions) -> bytes:
        keep = np.ones((int(positions[-1]) // 8 + 1) * 8, np.uint8)
        keep[np.asarray(positions)] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return dropped.map(pack)


def keep_mask(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Decode a bitmap to ``n_lines`` booleans; no bitmap keeps everything."""
    mask = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        mask[: len(bits)] = bits.astype(bool)
    return mask


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def cut(t, b):
        if b is None:
            return None
        lines = t.split("\n")
        mask = keep_mask(b, len(lines))
        return "\n".join(x for x, k in zip(lines, mask, strict=True) if k)

    return pd.Series([cut(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def line_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Keep bitmaps of the documents that lose lines.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses all its lines except in the largest doc_id that holds it.
    Returns (doc_id long, text_h long, n_dropped long, bitmap binary); bit i of the
    zlib-packed bitmap says whether line i stays, lines past its end stay.
    Repeated rows of one doc_id count as one document; ``text_h`` tells apart
    rows that share a doc_id but not a text. Rows with a null doc_id are one document
    that is less than all others, listed under the least long. Empty input gives no rows.
    """
    rows = materialize(line_rows(docs, min_chars), "lines")
    ranged = rows.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions(
        "h1", "h2", F.col("doc_id").desc(), "pos"
    )
    streamed = materialize(ranged.mapInArrow(_stream(min_docs), _ROW + ", pending boolean"), "line-drops")
    pending = streamed.where("pending")
    # At most two keys per range partition: bounded by the partition count.
    border = (
        pending.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    late = pending.join(F.broadcast(border), ["h1", "h2"]).where("doc_id <> keeper")
    drops = streamed.where("not pending").select("doc_id", "text_h", "pos").unionByName(
        late.select("doc_id", "text_h", "pos")
    )
    per_doc = drops.groupBy("doc_id", "text_h").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return per_doc.select("doc_id", "text_h", F.size("at").cast("long").alias("n_dropped"), _pack("at").alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` plus (line_n, line_dropped, line_kept): counts and the remaining text."""
    b = bitmaps.select(
        F.col("doc_id").alias("_b_id"), F.col("text_h").alias("_b_h"), F.col("n_dropped").alias("_b_n"), F.col("bitmap").alias("_b_bits")
    )
    d = docs.withColumn("_h", F.xxhash64(text_or_empty()))
    b = materialize(b, "bitmaps")
    if small_enough(b, size_of=F.octet_length("_b_bits") + 32):
        b = F.broadcast(b)
    joined = d.join(b, (_id(F.col("doc_id")) == F.col("_b_id")) & (F.col("_h") == F.col("_b_h")), "left")
    hit = F.col("_b_bits").isNotNull()
    text = text_or_empty()
    return joined.select(
        *[d[c] for c in docs.columns],
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_n"),
        F.coalesce("_b_n", F.lit(0)).cast("long").alias("line_dropped"),
        F.when(hit, _apply(F.when(hit, text), F.col("_b_bits"))).otherwise(text).alias("line_kept"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    Null and empty texts are one empty line. Rows with a null doc_id are one document
    that is less than all others.
    """
    base = docs.select("doc_id", "text")
    out = apply_bitmaps(base, line_bitmaps(base, min_docs, min_chars))
    return out.select(
        "doc_id",
        F.col("line_n").alias("n_lines"),
        F.col("line_dropped").alias("n_dropped"),
        F.sha2(F.col("line_kept"), 256).alias("kept_sha256"),
        F.col("line_kept").alias("kept_text"),
    )
