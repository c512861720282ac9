"""Shared pieces of the training-data operators: scratch tables and text primitives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast; callers count first and
#: fall back to a shuffled join beyond it.
BROADCAST_ROWS = 200_000

SPACE = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session leaves it unset (tests, local runs) is a local
    temporary folder chosen, once per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared scratch folder and read it back.

    Cuts lineage: losing an executor later re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    # The read below only follows a write that ended, so no marker file is needed.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once whatever reads them has been written."""
    for df in tables:
        path = df.__dict__.pop("scratch_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only after counting that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size_of: Column | None = None, size: int = 64 << 20) -> bool:
    """Whether ``df`` has at most ``rows`` rows and, by ``size_of``, at most ``size`` bytes."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(size_of) if size_of is not None else F.lit(0)).first()
    return n <= rows and (total or 0) <= size


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not listed in ``gone`` (doc_id, text_h); a
    null doc_id equals a null doc_id.

    Texts stay where they are while ``gone`` is small enough to broadcast.
    """
    listed = gone.select(F.col("doc_id").alias("_g_id"), F.col("text_h").alias("_g_h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_g_id")) & (F.xxhash64(text_or_empty()) == F.col("_g_h"))
    return docs.join(bounded_broadcast(listed), same, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def space_words(text: Column) -> Column:
    """Maximal runs of characters other than U+0020 and U+0009..U+000D."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def alnum_words(text: Column) -> Column:
    """A-Z lowered; runs of ASCII letters, digits and any non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")
