"""Memory of human corrections: merge without repetition, recall by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_term, source_key

KEY = ("key", "page_type", "context")


def keyed(records: DataFrame) -> DataFrame:
    return records.withColumn("key", source_key(F.col("source_text")))


def additions(memory: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned corrections that the memory does not hold, each key and text once, the
    first by ``seq``."""
    once = Window.partitionBy(*KEY, "corrected").orderBy("seq")
    new = keyed(learned).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return new.join(keyed(memory).select(*KEY, "corrected").distinct(), [*KEY, "corrected"], "left_anti").select(learned.columns)


def merge(memory: DataFrame, learned: DataFrame) -> DataFrame:
    return memory.unionByName(additions(memory, learned))


def competing(memory: DataFrame) -> DataFrame:
    """(key..., n_texts): keys with more than one corrected text."""
    return keyed(memory).groupBy(*KEY).agg(F.count_distinct("corrected").alias("n_texts")).where("n_texts > 1")


def learnable(review: DataFrame) -> DataFrame:
    """Edited approvals whose text really changed."""
    reviewed, suggested = F.btrim(F.coalesce("reviewed", F.lit(""))), F.btrim(F.coalesce("suggested", F.lit("")))
    return review.where((F.col("status") == "approved_edited") & (F.coalesce("reviewed", F.lit("")) != "") & (reviewed != suggested))


def recall(request: DataFrame, memory: DataFrame) -> DataFrame:
    """(item_id, corrected, seq, warnings, requires_confirmation) of every remembered
    correction of an item's key.

    ``request``: item_id, source_text, page_type, context, targets array of strings.
    """
    q = keyed(request).select("item_id", *KEY, "targets")
    m = keyed(memory).select(*KEY, "corrected", "seq")
    many = competing(memory).select(*KEY, F.lit(True).alias("_many"))
    lost = F.exists("targets", lambda x: (x != "") & ~F.contains(normalize_term(F.col("corrected")), normalize_term(x)))
    listed = F.array_compact(F.array(F.when(F.col("_many"), "conflicting_corrections"), F.when(lost, "glossary_conflict")))
    out = q.join(m, list(KEY)).join(many, list(KEY), "left").withColumn("warnings", listed)
    return out.select("item_id", "corrected", "seq", "warnings", (F.size("warnings") > 0).alias("requires_confirmation"))
