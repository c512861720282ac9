"""Quality rules with thresholds that adapt to each language and source.

Native only. Every document gets integer metrics; each (lang, source) group keeps a
mergeable quantile sketch per metric: counts of log-linear buckets (values below 64
exact, above that 32 buckets per power of two, so at most 1/32 relative error).
Sketches merge by adding counts. A group's sketch is blended with that of its language,
and a language's with the corpus's, each weighing as much as ``prior`` documents, so
a small group leans on its language and a large one stands for itself. Quantiles and
spread read from the blended sketch give the thresholds, which are joined back to the
documents' metrics; no metric has a fixed cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_broadcast, materialize, space_words, text_or_empty

METRICS = ("m_symbols", "m_dup_lines", "m_repeats", "m_upper", "m_word_len")
#: Words of a repeated window.
GRAM = 5


def base_counts(text: Column) -> list[Column]:
    """Counts of one text; a null text has no words.

    Windows are compared by 64-bit hash within one document.
    """
    words, n = F.col("words"), F.size("words")
    grams = F.when(
        n >= GRAM,
        F.transform(
            F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(GRAM)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return [
        F.col("doc_id"), F.col("lang"), F.col("source"), F.xxhash64(text).alias("text_h"), n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"), grams.alias("grams"),
    ]


def _repeated_places() -> Column:
    """Places whose hash occurs at least twice in ``placed``, sorted (hash, place) pairs."""
    n = F.size("placed")
    gap = F.array(F.lit(None).cast("struct<g:bigint,i:int>"))
    beside = F.arrays_zip(
        F.col("placed").alias("here"),
        F.concat(gap, F.slice("placed", 1, F.greatest(n - 1, F.lit(0)))).alias("before"),
        F.concat(F.slice("placed", 2, F.greatest(n - 1, F.lit(0))), gap).alias("after"),
    )
    same = F.filter(
        beside,
        lambda x: F.coalesce(x["here"]["g"] == x["before"]["g"], F.lit(False))
        | F.coalesce(x["here"]["g"] == x["after"]["g"], F.lit(False)),
    )
    return F.sort_array(F.transform(same, lambda x: x["here"]["i"]))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row."""
    words = docs.select("doc_id", "lang", "source", text_or_empty().alias("text")).withColumn(
        "words", space_words(F.col("text"))
    )
    rows = words.select(*base_counts(F.col("text")))
    n_lines = F.size("lines")
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    # Only texts with a repeated window are sorted.
    rows = rows.withColumn(
        "placed",
        F.when(
            repeated, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        ),
    ).withColumn("again", F.when(F.col("placed").isNotNull(), _repeated_places()))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + (p + GRAM - F.greatest(p, acc["end"]))).cast("long").alias("n"), (p + GRAM).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return rows.select(
        "doc_id", "lang", "source", "text_h", "n_words", "word_chars", "n_symbols",
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper", n_lines.cast("long").alias("n_text_lines"),
    )


def _per_mille(part: str, whole: str) -> Column:
    return F.floor(F.try_divide(F.col(part) * 1000, F.greatest(F.col(whole), F.lit(1)))).cast("long")


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "m_symbols": _per_mille("n_symbols", "word_chars"),
            "m_dup_lines": _per_mille("n_dup_lines", "n_text_lines"),
            "m_repeats": _per_mille("n_repeat_words", "n_words"),
            "m_upper": _per_mille("n_upper", "word_chars"),
            "m_word_len": F.floor(
                F.try_divide(F.col("word_chars") * 100, F.greatest(F.col("n_words"), F.lit(1)))
            ).cast("long"),
        }
    )


def bucket(value: Column) -> Column:
    """Lower bound of the log-linear bucket of a non-negative integer."""
    digits = F.length(F.bin(value))
    scale = F.when(digits > 6, F.pow(F.lit(2), digits - 6).cast("long")).otherwise(F.lit(1).cast("long"))
    return value - value % scale


def sketch(metrics: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch per group and metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    rows = metrics.where("n_words > 0").select("lang", "source", pairs.alias("p"))
    return rows.groupBy("lang", "source", "p.metric", bucket(F.col("p.value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The union of the sketches that agree on ``by``."""
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def blended(sketches: DataFrame, prior: float) -> DataFrame:
    """(lang, source, metric, bucket, w): each group's counts plus ``prior`` documents
    spread like its language, whose own sketch has ``prior`` documents spread like the corpus."""
    corpus = merged(sketches, []).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("metric")))
    corpus = F.broadcast(corpus.select("metric", "bucket", F.col("share").alias("c_share")))
    lang = merged(sketches, ["lang"])
    sizes = lang.groupBy("lang", "metric").agg(F.sum("n").alias("l_docs")).join(corpus, "metric")
    lang = lang.select(F.col("lang").alias("_lang"), F.col("metric").alias("_m"), F.col("bucket").alias("_b"), F.col("n").alias("l_n"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_m")) & (F.col("bucket") == F.col("_b"))
    like = (F.coalesce("l_n", F.lit(0)) + prior * F.col("c_share")) / (F.col("l_docs") + prior)
    lang = sizes.join(lang, same, "left").select(
        F.col("lang").alias("_lang"), F.col("metric").alias("_m"), "bucket", like.alias("like")
    )
    groups = sketches.select("lang", "source", "metric").distinct()
    spread = groups.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_m"))).select(
        "lang", "source", "metric", "bucket", (prior * F.col("like")).alias("w")
    )
    own = sketches.select("lang", "source", "metric", "bucket", F.col("n").cast("double").alias("w"))
    return spread.unionByName(own).groupBy("lang", "source", "metric", "bucket").agg(F.sum("w").alias("w"))


def group_cuts(sketches: DataFrame, prior: float, spread: int) -> DataFrame:
    """(lang, source, cut_...): q90 + spread * (q90 - q50 + mean) of each blended sketch."""
    keys = ["lang", "source", "metric"]
    w = Window.partitionBy(*keys)
    ranked = blended(sketches, prior).select(
        *keys, "bucket", "w", F.sum("w").over(w).alias("all"), F.sum("w").over(w.orderBy("bucket")).alias("upto")
    )
    # Sums of doubles: what misses a quantile by rounding still counts as reaching it.
    reached = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all") - 1e-6, F.col("bucket")))
    read = ranked.groupBy(*keys).agg(
        reached(0.5).alias("q50"), reached(0.9).alias("q90"), (F.sum(F.col("bucket") * F.col("w")) / F.max("all")).alias("mean")
    )
    cut = F.floor(F.col("q90") + spread * (F.col("q90") - F.col("q50") + F.col("mean")) + 1e-6).cast("long")
    return read.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, cut)).alias(f"cut_{m}") for m in METRICS])


def quality_rules(docs: DataFrame, prior: float = 100.0, spread: int = 5, salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, text_h (xxhash64 of the text) and the metrics with
    their ``cut_`` thresholds.

    Null and empty texts have no words and fail. A null lang or source forms a group
    of its own. Repeated rows are judged alike. Documents above any threshold of
    their group are rejected. Thresholds join by broadcast up to a checked number of
    groups; beyond it the documents are salted over ``salts`` copies of the table.
    """
    metrics = materialize(with_metrics(document_counts(docs)), "quality-metrics")
    sketches = materialize(sketch(metrics), "quality-sketch")
    cuts = materialize(group_cuts(sketches, prior, spread), "quality-cuts").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"cut_{m}" for m in METRICS]
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    small = bounded_broadcast(cuts)
    if small is cuts:
        metrics = metrics.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
        small = cuts.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = same & (F.col("_salt") == F.col("_salted"))
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"cut_{m}"), F.lit(True))
    return metrics.join(small, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "text_h", *METRICS, *[f"cut_{m}" for m in METRICS],
    )
