"""Corpus cleaning in five stages, each one operator applied to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as
Parquet and reads again for the next one; all but the last return the columns of
``documents``, also where further columns have names that the operators use. Nulls,
empty and repeated rows follow the stages' docstrings: a document without words is
rejected by the quality rules, a null doc_id takes no part in the Jaccard stage, where
repeated rows of one document collapse to one. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules
from marginalia.llm.common import bounded_broadcast, discard, materialize, table, text_or_empty, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Repeated
    rows are judged alike; a null lang or source is a group of its own."""
    judged = quality_rules.quality_rules(docs)
    return without(docs, judged.where("NOT kept").select("doc_id", "text_h"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text that is left. Null texts stay null."""
    cut = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    text = F.when(F.col("text").isNotNull(), F.col("line_kept"))
    changed = F.col("line_dropped") > 0
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of least doc_id, and of
    least text hash where rows share it. Of fully repeated rows one stays. Texts without
    words and rows with a null doc_id are compared with nothing and stay."""
    found = jaccard_join.near_duplicates(docs).where("n_links > 0").select("doc_id", "text_h", "class_key")
    linked = materialize(found, "linked")
    keepers = linked.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_h")).alias("keeper"))
    keepers = bounded_broadcast(materialize(keepers, "keepers"))
    losers = linked.join(keepers, "class_key").where(F.struct("doc_id", "text_h") != F.col("keeper"))
    kept = without(docs, losers)
    repeated = materialize(linked.groupBy("doc_id", "text_h").count().where("count > 1").select("doc_id", "text_h"), "repeated")
    if repeated.isEmpty():
        return kept
    # The rows of one document and text are the same but for their other columns.
    marked = kept.withColumn("_text_h", F.xxhash64(text_or_empty()))
    again = bounded_broadcast(repeated.select(F.col("doc_id").alias("_r_id"), F.col("text_h").alias("_r_h")))
    same = (F.col("doc_id") == F.col("_r_id")) & (F.col("_text_h") == F.col("_r_h"))
    once = marked.join(again, same, "left_semi").dropDuplicates(["doc_id", "_text_h"])
    return marked.join(again, same, "left_anti").unionByName(once).drop("_text_h")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, all rows that repeat them too.
    Null and empty texts hold none and stay; a null doc_id is a document like any other."""
    return without(docs, decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_h"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, share: float = 0.8) -> DataFrame:
    """A sample of ``share`` of the tokens toward the target weights, with its topic,
    tokens, weight and probability."""
    mixed = mixing.mixing(docs, share=share)
    return mixed.where("kept").drop("kept")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The Jaccard stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
