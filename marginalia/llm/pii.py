"""Personal data: overlapping span candidates, boosted trees, calibrated thresholds.

Native only. Generators are regular expressions: four base kinds that a validator
confirms, and wide nets for keys, local phone numbers, account numbers and long digit
groups. A split by the same expression gives the gaps between matches, so positions
are running sums. Every candidate gets format and context features; trees boosted on a
bounded sample of the nets' candidates, shared out among the kinds, become one CASE
expression. Labels come from the words before a span that name its kind; those words
are no features, so the trees have to tell from the format and the marks around a span
what is usually named so. A kind's threshold is the least that reaches the wanted precision on
all its candidates outside that sample, counted by score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, text_or_empty

#: The base kinds, in the order of their listing. Possessive repeats match the same
#: text as plain ones here and need no stack; the look-behinds only skip starts that
#: an earlier start of the same run covers.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide nets, in alphabetical order; none of them is trusted without a score.
NETS = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "digits": r"(?<![0-9+])[0-9](?:[\x20./-]?[0-9]){7,}+",
    "local": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
#: A cheap test that any match of the kind must pass.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"} | {
    "account": "[A-Z]{2}[0-9]{2}", "digits": r"[0-9][\x20./-]?[0-9]", "local": "[0-9]{3}", "secret": "[A-Za-z0-9_+/=-]{20}"
}
ORDER = [*BASE, *NETS]
#: Words before a span that name what follows. They label and are no features.
CUES = {
    "cue_key": r"(?i)(token|secret|passw|api|key|bearer|credential)",
    "cue_call": r"(?i)(tel|phone|call|fax|mobile|contact)",
    "cue_bank": r"(?i)(card|visa|iban|account|bank|ssn|passport)",
}
FEATURES = (
    "x_kind", "x_len", "x_digits", "x_letters", "x_upper", "x_seps", "x_groups", "x_distinct", "x_luhn", "x_mixed",
    "x_word_before", "x_word_after", "x_quoted", "x_assigned", "x_line_start", "x_bracket",
)


def _generated(kind: str) -> tuple[Column, Column]:
    """The leftmost non-overlapping matches of a kind and the gaps around them; texts that
    cannot match are not searched, those without a match not split."""
    matches = F.when(F.col("text").rlike(NEEDS[kind]), F.regexp_extract_all("text", F.lit((BASE | NETS)[kind]), F.lit(0)))
    gaps = F.when(F.size(f"m_{kind}") > 0, F.split("text", (BASE | NETS)[kind], -1))
    return matches.alias(f"m_{kind}"), gaps.alias(f"p_{kind}")


def _matches(texts: DataFrame) -> DataFrame:
    """(doc_id, text_h, kind, i, gap, found, before, after) of all generators, in one scan."""
    made = {kind: _generated(kind) for kind in ORDER}
    hit = texts.select("doc_id", "text_h", "text", *[m for m, _ in made.values()])
    hit = hit.where(F.greatest(*[F.coalesce(F.size(f"m_{k}"), F.lit(0)) for k in ORDER]) > 0)
    hit = hit.select("doc_id", "text_h", *[f"m_{k}" for k in ORDER], *[p for _, p in made.values()])

    def proposals(kind: str) -> Column:
        gap = lambda i: F.get(f"p_{kind}", i)
        return F.transform(
            F.coalesce(f"m_{kind}", F.array().cast("array<string>")),
            lambda found, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.char_length(gap(i)).alias("gap"), found.alias("found"),
                F.right(gap(i), F.lit(24)).alias("before"), F.left(gap(i + 1), F.lit(2)).alias("after"),
            ),
        )

    return hit.select("doc_id", "text_h", F.inline(F.concat(*[proposals(k) for k in ORDER])))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_h, kind, start, end, base, features...): every proposed span, in code
    points, end exclusive. ``base`` marks the base kinds' confirmed matches."""
    texts = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("text_h"))
    # Rows that share id and text would sum their gaps twice.
    found = _matches(texts).distinct()
    until = Window.partitionBy("doc_id", "text_h", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("found")).over(until)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("found"))
    digits = F.regexp_replace("found", "[^0-9]+", "")
    n = F.char_length("found")
    only = lambda c: F.char_length(F.regexp_replace("found", f"[^{c}]+", ""))
    octets = F.split("found", "\\.")
    valid = (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.forall(octets, lambda x: F.regexp_replace(x, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(F.col("kind") == "card", F.char_length(digits).between(16, 19) & luhn(digits))
        .when(F.col("kind") == "phone", F.char_length(digits).between(8, 15))
        .otherwise(False)
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    return placed.select(
        "doc_id", "text_h", "kind", "start", "end", valid.alias("base"),
        rank.cast("double").alias("x_kind"), n.cast("double").alias("x_len"), only("0-9").cast("double").alias("x_digits"),
        only("A-Za-z").cast("double").alias("x_letters"), only("A-Z").cast("double").alias("x_upper"),
        (n - only("0-9A-Za-z")).cast("double").alias("x_seps"),
        F.size(F.filter(F.split("found", "[^0-9A-Za-z]+"), lambda x: x != "")).cast("double").alias("x_groups"),
        F.size(F.array_distinct(F.split("found", ""))).cast("double").alias("x_distinct"),
        F.coalesce(F.when(F.char_length(digits).between(12, 19), luhn(digits)), F.lit(False)).cast("double").alias("x_luhn"),
        F.size(F.regexp_extract_all("found", F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))).cast("double").alias("x_mixed"),
        F.col("before").rlike("[0-9A-Za-z]$").cast("double").alias("x_word_before"),
        F.col("after").rlike("^[0-9A-Za-z]").cast("double").alias("x_word_after"),
        F.col("before").rlike("[\"'`]$").cast("double").alias("x_quoted"),
        F.col("before").rlike("[=:]\\x20*[\"'`]?$").cast("double").alias("x_assigned"),
        F.col("before").rlike("(^|\n)$").cast("double").alias("x_line_start"),
        F.col("before").rlike("[(\\[{|]\\x20?$").cast("double").alias("x_bracket"),
        *[F.col("before").rlike(p).cast("double").alias(c) for c, p in CUES.items()],
    )


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | float = 0.0
    high: Node | float = 0.0


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float) -> Node | float:
    total_g, total_h = g.sum(), h.sum()
    leaf = float(rate * total_g / (total_h + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best, at = 1e-6, None
    for f, options in enumerate(cuts):
        for c in options:
            low = x[:, f] <= c
            lg, lh = g[low].sum(), h[low].sum()
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            if gain > best and low.any() and not low.all():
                best, at = gain, (f, float(c))
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return Node(*at, _grow(x[low], g[low], h[low], cuts, depth - 1, rate), _grow(x[~low], g[~low], h[~low], cuts, depth - 1, rate))


def _value(node: Node | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, Node):
        return np.full(len(x), node)
    return np.where(x[:, node.feature] <= node.cut, _value(node.low, x), _value(node.high, x))


def _case(node: Node | float) -> Column:
    if not isinstance(node, Node):
        return F.lit(float(node))
    return F.when(F.col(FEATURES[node.feature]) <= node.cut, _case(node.low)).otherwise(_case(node.high))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 2, rate: float = 0.4) -> list[Node | float]:
    """Gradient-boosted logistic trees; the first entry is the prior's log odds."""
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= 16 else np.unique(np.quantile(middle, np.linspace(0, 1, 16))))
    p = (y.sum() + 1) / (len(y) + 2)
    trees: list[Node | float] = [float(np.log(p / (1 - p)))]
    score = np.full(len(y), trees[0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - q, q * (1 - q), cuts, depth, rate)
        trees.append(tree)
        score += _value(tree, x)
    return trees


def calibrated(counts: list, precision: float) -> dict[str, float]:
    """The least score per kind from which the precision is reached; none: infinity.
    ``counts`` has (kind, score, n, positives) of every kind and score."""
    out = {}
    for kind in NETS:
        n = good = 0
        out[kind] = float("inf")
        for _, score, more, positives in sorted((r for r in counts if r[0] == kind), key=lambda r: -r[1]):
            n, good = n + more, good + positives
            if good >= precision * n:
                out[kind] = score
    return out


def shares(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The share of each kind's candidates to learn from: at most half, ``rows`` in all,
    dealt evenly among the kinds; what a rare kind leaves goes to the others."""
    out, left = {}, rows
    for i, (kind, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        mine = min(n / 2, left / (len(counts) - i))
        out[kind] = mine / n
        left -= mine
    return out


def weak_label(spans: DataFrame) -> DataFrame:
    """The candidates of the nets plus ``y``: whether a word before the span names its kind.

    The trees never see those words. They learn from format and marks which spans are
    like the named ones, and so also find spans that nothing names.
    """
    named = F.when(F.col("kind") == "secret", F.col("cue_key")).when(F.col("kind") == "local", F.col("cue_call")).otherwise(F.col("cue_bank"))
    return spans.where(F.col("kind").isin(*NETS)).withColumn("y", (named > 0).cast("int"))


def scored(spans: DataFrame, max_rows: int, precision: float) -> DataFrame:
    """``spans`` plus (score, picked). Trees learn from about half of ``max_rows``
    candidates, taken by hash, thresholds are calibrated on all others."""
    kinds = dict(spans.where(F.col("kind").isin(*NETS)).groupBy("kind").count().collect())
    part = F.pmod(F.xxhash64("doc_id", "text_h", "kind", "start"), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for kind, s in shares(kinds, max_rows // 2).items():
        share = F.when(F.col("kind") == kind, s).otherwise(share)
    labelled = weak_label(spans)
    rows = labelled.where(part < share).select("y", *FEATURES).collect()
    learn = np.array([list(r) for r in rows], float).reshape(-1, 1 + len(FEATURES))
    if len(learn) == 0:
        return spans.withColumns({"score": F.lit(0.0), "picked": F.lit(False)})
    # Summed in one order, whatever order the rows came in.
    learn = learn[np.lexsort(learn.T)]
    total = F.lit(0.0)
    for t in boost(learn[:, 1:], learn[:, 0]):
        total = total + _case(t)
    score = 1.0 / (1.0 + F.exp(-total))
    # A score counts by its first four digits, so that at most 10 001 a kind are told apart.
    step = F.floor(score * 10_000).cast("int")
    held = labelled.where(part >= share).groupBy("kind", step.alias("step"))
    cuts = calibrated(held.agg(F.count(F.lit(1)), F.sum("y")).collect(), precision)
    picked = F.lit(False)
    for kind, cut in cuts.items():
        if cut != float("inf"):
            picked = picked | ((F.col("kind") == kind) & (step >= cut))
    return spans.withColumn("score", score).withColumn("picked", picked)


def pii_spans(docs: DataFrame, max_rows: int = 20_000, precision: float = 0.95) -> DataFrame:
    """(doc_id, text_h, kind, start, end, base, score): the spans to redact.

    Confirmed base spans always stay, failed base matches go. Candidates of the nets are
    selected by their score; one that overlaps a base span is left to it.
    """
    spans = materialize(candidates(docs), "pii-candidates")
    judged = scored(spans, max_rows, precision).where(F.col("base") | (F.col("picked") & F.col("kind").isin(*NETS)))
    by_start = Window.partitionBy("doc_id", "text_h").orderBy("start", "end", "kind")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    clear = F.coalesce(ended <= F.col("start"), F.lit(True)) & F.coalesce(begins >= F.col("end"), F.lit(True))
    return judged.withColumn("clear", clear).where("base OR clear").select(
        "doc_id", "text_h", "kind", "start", "end", "base", "score"
    )


def find_pii(docs: DataFrame, max_rows: int = 20_000, precision: float = 0.95) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Null texts are empty; texts without spans hash and list the empty string. Repeated
    rows get the same spans each. A null doc_id is a document like any other.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    entry = F.struct(rank.alias("r"), F.col("start"), F.col("end"), "kind", "base")
    found = pii_spans(docs, max_rows, precision).groupBy("doc_id", "text_h").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(entry)).alias("all"), F.count(F.lit(1)).alias("n_all"),
    )
    show = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = found.select(
        F.col("doc_id").alias("_id"), F.col("text_h").alias("_h"), *[f"n_{k}" for k in BASE],
        show(F.filter("all", lambda x: x["base"])).alias("base_list"), show(F.col("all")).alias("spans"), "n_all",
    )
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_h"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_h") == F.col("_h")), "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_list", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_all", F.lit(0)).cast("long").alias("n_spans"),
    )
