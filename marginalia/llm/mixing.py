"""Mixing to target weights by iterative proportional fitting.

Native only. Token counts are summed to (source, lang, topic) cells; the cell
weights are raked until their source, language and topic marginals meet the
targets. Documents are then kept with a probability that is proportional to
weight / tokens of their cell and scaled so that the expected number of sampled
tokens is the wanted share of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_broadcast, discard, materialize, space_words, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Up to so many cells are raked as arrays of one row; more are raked as tables.
ARRAY_CELLS = 50_000
#: Words that name a topic; each also counts capitalised and in capitals.
TOPICS = {
    "code": ("class", "const", "def", "function", "import", "int", "return", "static", "string", "var", "void"),
    "credentials": ("apikey", "bearer", "key", "login", "password", "secret", "token"),
    "finance": ("account", "bank", "budget", "card", "cost", "invoice", "market", "price", "tax", "trade"),
    "health": ("clinic", "disease", "doctor", "drug", "health", "hospital", "medicine", "patient"),
    "legal": ("agreement", "clause", "copyright", "court", "law", "liability", "license", "permission", "rights", "warranty"),
    "science": ("atom", "cell", "data", "energy", "experiment", "method", "model", "physics", "theorem", "theory"),
    "sport": ("coach", "cup", "game", "goal", "league", "match", "player", "season", "team"),
}
#: Marks by whose share of the characters a text without such words is told.
TABLE_MARKS, CODE_MARKS = "|", "#*$%&<>{}=;"


def topic_words() -> dict[str, str]:
    """Topic by word, in the three spellings that count."""
    return {form: topic for topic, listed in TOPICS.items() for w in listed for form in (w, w.capitalize(), w.upper())}


def topic_of(words: Column, text: Column) -> Column:
    """The topic whose words occur most often, the first by name among equals. A text
    without any is ``table`` or ``symbols`` by the marks it is made of, ``figures`` where
    a tenth of its characters are digits, else ``general``; without words it is ``empty``."""
    listed = topic_words()
    by_word = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])
    known = list(listed)
    none = F.array().cast("array<string>")
    some = F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))
    found = F.when(some, F.transform(F.filter(words, lambda w: w.isin(known)), lambda w: by_word[w])).otherwise(none)
    ranked = F.transform(
        F.array_distinct(found), lambda t: F.struct((-F.size(F.filter(found, lambda x: x == t))).alias("n"), t.alias("topic"))
    )
    n = F.char_length(text)
    share = lambda marks: n - F.char_length(F.regexp_replace(text, f"[{marks}]+", ""))
    return (
        F.when(F.size(words) == 0, "empty")
        .when(F.size(found) > 0, F.array_min(ranked)["topic"])
        .when(share(TABLE_MARKS) * 50 > n, "table")
        .when(share(CODE_MARKS) * 20 > n, "symbols")
        .when(share("0-9") * 10 > n, "figures")
        .otherwise("general")
    )


def smoothed_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): shares of the observed marginal raised to ``power``."""
    seen = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    total = seen.select(F.sum(F.pow("t", F.lit(power))).alias("all"))
    return seen.crossJoin(F.broadcast(total)).select(margin, (F.pow("t", F.lit(power)) / F.col("all")).alias("target"))


def _targeted(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Cells with tokens whose three margin values all have a target, with ``t_`` columns."""
    now = cells.where("tokens > 0")
    for m in MARGINS:
        aim = bounded_broadcast(targets[m].select(F.col(m).alias(f"_{m}"), F.col("target").alias(f"t_{m}")))
        now = now.join(aim, F.col(m).eqNullSafe(F.col(f"_{m}"))).drop(f"_{m}")
    return now


def _array_rake(cells: DataFrame, tolerance: float, steps: int) -> DataFrame:
    """One row (f0, f1, f2, worst): factors of the margin values, raked in the JVM as a fold.

    ``cells`` has the indexes i0, i1, i2 of its margin values and tokens. Every step
    refits one margin; it ends when the last three steps moved no margin value by
    more than ``tolerance``, relative to its target.
    """
    one = None
    for m in range(3):
        a, b = [x for x in range(3) if x != m]
        part = F.struct(F.col("tokens").cast("double").alias("n"), F.col(f"i{a}").alias("a"), F.col(f"i{b}").alias("b"))
        by_value = cells.groupBy(F.col(f"i{m}").alias("i"), F.col(f"t{m}").alias("t")).agg(F.sort_array(F.collect_list(part)).alias("cells"))
        row = by_value.agg(F.array_sort(F.collect_list(F.struct("i", "t", "cells"))).alias(f"m{m}"))
        one = row if one is None else one.crossJoin(F.broadcast(row))

    def step(state: Column, i: Column) -> Column:
        def refit(m: int) -> Column:
            a, b = [x for x in range(3) if x != m]

            def factor(v: Column) -> Column:
                total = F.aggregate(
                    v["cells"], F.lit(0.0),
                    lambda acc, c: acc + c["n"] * F.get(state[f"f{a}"], c["a"]) * F.get(state[f"f{b}"], c["b"]),
                )
                return F.coalesce(F.try_divide(v["t"], total), F.lit(0.0))

            def moved(new: Column) -> Column:
                apart = F.zip_with(new, state[f"f{m}"], lambda x, y: F.when(x > 0, F.abs(y / x - 1)).otherwise(0.0))
                error = F.array_max(apart)
                return F.struct(
                    *[(new if k == m else state[f"f{k}"]).alias(f"f{k}") for k in range(3)],
                    *[(error if k == m else state[f"e{k}"]).alias(f"e{k}") for k in range(3)],
                )

            return F.get(F.transform(F.array(F.transform(F.col(f"m{m}"), factor)), moved), F.lit(0))

        settled = F.greatest(state["e0"], state["e1"], state["e2"]) <= tolerance
        return F.when(settled, state).when(i % 3 == 0, refit(0)).when(i % 3 == 1, refit(1)).otherwise(refit(2))

    start = F.struct(
        *[F.transform(F.col(f"m{m}"), lambda _: F.lit(1.0)).alias(f"f{m}") for m in range(3)],
        *[F.lit(float("inf")).alias(f"e{m}") for m in range(3)],
    )
    done = one.select(F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step).alias("s"))
    return done.select("s.f0", "s.f1", "s.f2", F.greatest("s.e0", "s.e1", "s.e2").alias("worst"))


def _table_rake(cells: DataFrame, tolerance: float, steps: int) -> tuple[DataFrame, float]:
    """``cells`` with ``weight``: as :func:`_array_rake`, one written table of cells a round."""
    now, worst = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "rake"), float("inf")
    for _ in range(-(-steps // 3)):
        following, errors = now, []
        for m in range(3):
            sums = following.groupBy(f"i{m}").agg(F.sum("weight").alias("_sum"), F.max(f"t{m}").alias("_aim"))
            scale = materialize(sums.select(F.col(f"i{m}").alias("_i"), (F.col("_aim") / F.col("_sum")).alias("_scale")), f"rake-{m}")
            errors.append(scale.agg(F.max(F.abs(1 / F.col("_scale") - 1))).first()[0] or 0.0)
            following = following.join(bounded_broadcast(scale), F.col(f"i{m}") == F.col("_i")).withColumn(
                "weight", F.col("weight") * F.col("_scale")
            ).drop("_i", "_scale")
        before, now = now, materialize(following, "rake")
        discard(before)
        worst = max(errors)
        if worst <= tolerance:
            break
    return now, worst


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-10, steps: int = 3000, array_cells: int = ARRAY_CELLS
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) plus ``weight``, summing to 1, and
    ``margin_error``, the worst relative distance of a margin value from its target.

    Each step scales the cells of one margin so that each value's sum meets its target;
    margins take turns until none is off by more than ``tolerance`` or ``steps`` are
    done, which only targets that contradict each other reach. Cells without tokens, and
    margin values without a target, get no weight. Up to ``array_cells`` cells the steps are
    one fold over arrays; more cells are raked as tables with the same result.
    """
    aimed = _targeted(cells, targets)
    for k, m in enumerate(MARGINS):
        index = materialize(
            aimed.select(m).distinct().agg(F.array_sort(F.collect_list(F.struct(m))).alias("v")).select(F.posexplode("v").alias("i", "v")), "rake-index"
        )
        values = index.select(F.col("i").alias(f"i{k}"), F.col(f"v.{m}").alias(f"_{m}"))
        aimed = aimed.join(bounded_broadcast(values), F.col(m).eqNullSafe(F.col(f"_{m}"))).drop(f"_{m}").withColumnRenamed(f"t_{m}", f"t{k}")
    aimed = materialize(aimed, "rake-cells")
    if aimed.count() > array_cells:
        weighed, worst = _table_rake(aimed, tolerance, steps)
        return weighed.select(*cells.columns, "weight", F.lit(float(worst)).alias("margin_error"))
    factors = materialize(_array_rake(aimed, tolerance, steps), "rake-factors")
    weight = F.col("tokens").cast("double")
    for k in range(3):
        weight = weight * F.get(F.col(f"f{k}"), F.col(f"i{k}"))
    return aimed.crossJoin(F.broadcast(factors)).select(*cells.columns, weight.alias("weight"), F.col("worst").alias("margin_error"))


def calibrate(raked: DataFrame, share: float) -> DataFrame:
    """``raked`` plus ``p``: keep probabilities of at most 1 whose expected tokens are
    ``share`` of the tokens of all cells.

    The scale is found by fixing the cells that reach 1 and rescaling the rest, until
    no further cell reaches 1; each round reads one row of sums.
    """
    wanted = share * (raked.agg(F.sum("tokens")).first()[0] or 0)
    scale, n_full = wanted, -1
    while True:
        full = F.col("weight") * scale >= F.col("tokens")
        n, done, rest = raked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not rest or n == n_full:
            break
        n_full, scale = n, (wanted - done) / rest
    return raked.withColumn("p", F.least(F.lit(1.0), F.col("weight") * F.lit(float(scale)) / F.col("tokens")))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id: 48 bits of an MD5."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def mixing(
    docs: DataFrame,
    share: float = 0.5,
    power: float = 0.5,
    tolerance: float = 1e-10,
    seed: str = "mix:",
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight, margin_error, p, kept.

    Tokens are whitespace-separated words. ``targets`` gives (margin, target) tables
    by margin name; a margin without one aims at its observed shares to the power
    ``power``. Empty and null texts have no tokens: weight and p are 0 and they are
    not kept. A null source or language is a value of its own. Rows with equal
    doc_id are kept or left together where they share a cell.
    """
    text = text_or_empty()
    words = docs.select("doc_id", "source", "lang", text.alias("text"), space_words(text).alias("words"))
    rows = materialize(
        words.select(
            "doc_id", "source", "lang", topic_of(F.col("words"), F.col("text")).alias("topic"), F.size("words").cast("long").alias("n_tokens")
        ),
        "mix-docs",
    )
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    wanted = {m: materialize((targets or {}).get(m, smoothed_targets(cells, m, power)), f"target-{m}") for m in MARGINS}
    raked = materialize(rake(cells, wanted, tolerance), "mix-weights")
    cell = bounded_broadcast(
        calibrate(raked, share).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "margin_error", "p")
    )
    same = F.lit(True)
    for m in MARGINS:
        same = same & F.col(m).eqNullSafe(F.col(f"_{m}"))
    p = F.when(F.col("n_tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    return rows.join(cell, same, "left").select(
        "doc_id", *MARGINS, "n_tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("margin_error", F.lit(0.0)).alias("margin_error"),
        p.alias("p"), (uniform(F.col("doc_id"), seed) < p).alias("kept"),
    )
