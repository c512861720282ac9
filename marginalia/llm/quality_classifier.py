"""Quality classifier: regularised quadratic discriminant on document statistics.

Statistics are built-in expressions over whole texts. Each class is a Gaussian whose
covariance shrinks toward the pooled one; the inverse Cholesky factors are computed
once on the driver and become a plain expression, so scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_broadcast, materialize, space_words, text_or_empty

FEATURES = (
    "f_words", "f_word_len", "f_symbols", "f_upper", "f_marks", "f_shouts", "f_digits", "f_same_next", "f_distinct",
    "f_lines", "f_line_len", "f_dup_lines",
)


def document_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` plus the transformed statistics of every whole text (null: empty)."""
    count = lambda chars: F.char_length(F.regexp_replace("text", f"[^{chars}]+", ""))
    rows = docs.select(*keep, text_or_empty().alias("text"))
    rows = rows.select(*keep, "text", space_words(F.col("text")).alias("w"), F.split("text", "\n", -1).alias("l"))
    counted = rows.select(
        *keep,
        F.size("w").alias("nw"),
        F.char_length(F.array_join("w", "")).alias("nc"),
        F.size(F.array_distinct("w")).alias("nd"),
        F.size(F.filter(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: a == b), lambda x: x)).alias("ns"),
        F.size("l").alias("nl"),
        F.size(F.array_distinct("l")).alias("ndl"),
        count("#*$%&|<>").alias("sym"), count("A-Z").alias("up"), count(".,;:").alias("mark"), count("!?").alias("shout"),
        count("0-9").alias("dig"),
    )
    chars, words = F.greatest("nc", F.lit(1)), F.greatest("nw", F.lit(1))
    share = lambda c, whole: F.sqrt(F.col(c) / whole)
    return counted.select(
        *keep,
        F.log1p("nw").alias("f_words"), F.log1p(F.col("nc") / words).alias("f_word_len"), share("sym", chars).alias("f_symbols"),
        share("up", chars).alias("f_upper"), share("mark", chars).alias("f_marks"), share("shout", chars).alias("f_shouts"),
        share("dig", chars).alias("f_digits"), share("ns", words).alias("f_same_next"),
        (F.log1p("nd") - F.log1p("nw")).alias("f_distinct"), F.log1p("nl").alias("f_lines"),
        F.log1p(F.col("nw") / F.col("nl")).alias("f_line_len"), F.sqrt(1 - F.col("ndl") / F.col("nl")).alias("f_dup_lines"),
    )


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor, log determinant and log prior; and the
    slope and offset that turn the log-density difference into a probability."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        d = [
            self.log_prior[c] - 0.5 * self.log_det[c] - 0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1)
            for c in (0, 1)
        ]
        return d[1] - d[0]

    def column(self) -> Column:
        """The calibrated probability of class 1 over the FEATURES columns."""
        density = []
        for c in (0, 1):
            centred = [F.col(f) - F.lit(float(m)) for f, m in zip(FEATURES, self.mean[c], strict=True)]
            distance = F.lit(0.0)
            for i, row in enumerate(self.inverse[c]):
                part = F.lit(0.0)
                for j in range(i + 1):
                    part = part + F.lit(float(row[j])) * centred[j]
                distance = distance + part * part
            density.append(F.lit(float(self.log_prior[c] - 0.5 * self.log_det[c])) - 0.5 * distance)
        z = F.lit(self.slope) * (density[1] - density[0]) + F.lit(self.offset)
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.1, ridge: float = 1e-3) -> Discriminant | None:
    """Fit on features and 0/1 labels; None unless both classes have two rows."""
    groups = [x[y == c] for c in (0, 1)]
    if min(len(g) for g in groups) < 2:
        return None
    spread = [np.cov(g.T) for g in groups]
    pooled = sum(s * len(g) for s, g in zip(spread, groups, strict=True)) / len(x)
    mean, inverse, log_det = [], [], []
    for s, g in zip(spread, groups, strict=True):
        shrunk = (1 - shrinkage) * s + shrinkage * pooled + ridge * np.diag(np.maximum(np.diag(pooled), 1e-4))
        lower = np.linalg.cholesky(shrunk)
        mean.append(g.mean(axis=0))
        inverse.append(np.linalg.inv(lower))
        log_det.append(2 * np.log(np.diag(lower)).sum())
    prior = np.log(np.array([len(g) for g in groups]) / len(x))
    model = Discriminant(np.array(mean), np.array(inverse), np.array(log_det), prior)
    # A logistic fit of the difference undoes the Gaussians' overconfidence.
    z = np.clip(model.difference(x), -60, 60)
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((y - p) * z).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
        hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(a, 0.0)), float(b)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 50_000) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from about ``max_rows`` labelled documents outside the held-out fold, all of
    them where there are no more: those whose xxhash64(doc_id) lies under a threshold set
    by their count. Statistics and scores cover every whole text. Without two
    rows of either class every score is the share of label 1 (0.5 without labels).
    Null labels are ignored; of labels of one doc_id that disagree the least counts.
    Null and empty texts are scored as texts without words; a null doc_id is not held out.
    """
    stats = materialize(document_statistics(docs, "doc_id"), "statistics")
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")
    )
    learnable = marked.where(~held_out("_id")).groupBy("_id").agg(F.min("quality").alias("quality"))
    n = learnable.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
    sample = learnable if n <= max_rows else learnable.where(place < int(max_rows / n * (1 << 40)))
    rows = stats.join(bounded_broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "quality", *FEATURES).toArrow()
    rows = rows.sort_by([("_id", "ascending"), ("f_words", "ascending")])
    y = rows["quality"].to_numpy()
    x = np.column_stack([rows[f].to_numpy() for f in FEATURES]) if len(y) else np.zeros((0, len(FEATURES)))
    model = fit(x, y)
    score = model.column() if model else F.lit(float(y.mean()) if len(y) else 0.5)
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )
