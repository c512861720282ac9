"""Matching of parsed nodes to positioned native spans.

Nodes and spans are (page, idx, text, x0, y0, x1, y1) with page diagonals; all joins are
within a page on normalised texts, so a batch of documents is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.geometry import Box, distance_ratio
from marginalia.functions.text import normalize_term, similarity
from marginalia.sources.scratch import staged

MAX_CHAIN = 4
SIDES = ("x0", "y0", "x1", "y1")


def _shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast: what texts take in a file, often
    a few bytes for many rows alike, says little of what they take in the driver's memory."""
    return rows.hint("merge")


def with_neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` plus norm, and the norms of the rows before and after on the page."""
    w = Window.partitionBy("page").orderBy("idx")
    n = rows.withColumn("norm", normalize_term(F.coalesce("text", F.lit(""))))
    return n.withColumns({"before": F.lag("norm").over(w), "after": F.lead("norm").over(w)})


def continuations(spans: DataFrame) -> DataFrame:
    """(page, a, b): span b continues span a, below with the same left edge or right of it
    on the same line."""
    valid = spans.where((F.col("norm") != "") & Box.of().valid())
    a = valid.select("page", *[F.col(c).alias(f"a_{c}") for c in ("idx", *SIDES)])
    b = valid.select("page", *[F.col(c).alias(f"b_{c}") for c in ("idx", *SIDES)])
    below = F.col("b_y0") - F.col("a_y1")
    left = F.abs(F.col("b_x0") - F.col("a_x0")) <= 3.0
    reach = F.greatest(F.lit(4.0), (F.col("a_y1") - F.col("a_y0")) * 0.75)
    level = F.abs((F.col("a_y0") + F.col("a_y1")) / 2 - (F.col("b_y0") + F.col("b_y1")) / 2) <= 1.5
    right = F.col("b_x0") - F.col("a_x1")
    follows = (left & below.between(-1.0, reach)) | (level & right.between(-1.0, 14.0))
    return a.join(_shuffled(b), "page").where((F.col("b_idx") > F.col("a_idx")) & follows).select("page", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))


def span_chains(spans: DataFrame) -> DataFrame:
    """(page, indices, text, sides, before, after): single spans and chains of 2 to 4.

    ``spans`` come from :func:`with_neighbours`; before and after are the neighbours of
    a chain's first and last span.
    """
    edges = continuations(spans)
    valid = spans.where((F.col("norm") != "") & Box.of().valid())
    chains = valid.select("page", F.array("idx").alias("indices"), F.col("norm").alias("text"), *SIDES, "before", "after")
    out, last = chains, chains
    step = edges.join(
        _shuffled(valid.select("page", F.col("idx").alias("b"), F.col("norm").alias("n_text"), *[F.col(s).alias(f"n_{s}") for s in SIDES], F.col("after").alias("n_after"))), ["page", "b"]
    )
    for _ in range(MAX_CHAIN - 1):
        grown = last.withColumn("a", F.element_at("indices", -1)).join(_shuffled(step), ["page", "a"])
        last = grown.select(
            "page", F.concat("indices", F.array("b")).alias("indices"), normalize_term(F.concat_ws(" ", "text", "n_text")).alias("text"),
            F.least("x0", "n_x0").alias("x0"), F.least("y0", "n_y0").alias("y0"), F.greatest("x1", "n_x1").alias("x1"), F.greatest("y1", "n_y1").alias("y1"),
            "before", F.col("n_after").alias("after"),
        )
        out = out.unionByName(last)
    return out


def _agreement(node: Column, other: Column) -> Column:
    return F.coalesce(node == other, F.lit(False)).cast("int")


def exact_matches(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(page, idx, indices, score, distance, sides, unique): chains of a node's text.

    The best by neighbours that agree, then by distance; ``unique`` is false when two
    share the best place, which leaves the node without a match.
    """
    c = chains.select("page", F.col("text").alias("norm"), "indices", F.col("before").alias("c_before"), F.col("after").alias("c_after"), *[F.col(s).alias(f"c_{s}") for s in SIDES])
    pairs = nodes.where("norm <> ''").join(_shuffled(c), ["page", "norm"])
    score = _agreement(F.col("before"), F.col("c_before")) + _agreement(F.col("after"), F.col("c_after"))
    ranked = pairs.withColumns({"score": score, "distance": distance_ratio(Box.of("c_"), Box.of(), F.col("diagonal"))})
    best = Window.partitionBy("page", "idx").orderBy(F.col("score").desc(), F.col("distance"))
    tied = Window.partitionBy("page", "idx", "score", "distance")
    top = ranked.withColumn("_r", F.rank().over(best)).withColumn("_n", F.count(F.lit(1)).over(tied)).where("_r = 1")
    return top.groupBy("page", "idx").agg(
        F.min("indices").alias("indices"), F.max("score").alias("score"), F.max("distance").alias("distance"),
        *[F.min_by(f"c_{s}", "indices").alias(s) for s in SIDES], (F.max("_n") == 1).alias("unique"),
    )


def nearest_fuzzy(nodes: DataFrame, spans: DataFrame, least: float = 0.92, radius: float = 0.03) -> DataFrame:
    """(page, idx, span_idx, similarity, distance, eligible): most similar span, then
    nearest, then first; spans that pass both thresholds come before all others."""
    s = spans.where("norm <> ''").select("page", F.col("idx").alias("span_idx"), F.col("norm").alias("s_norm"), *[F.col(x).alias(f"s_{x}") for x in SIDES])
    texts = nodes.select("page", "norm").distinct().join(_shuffled(s.select("page", "s_norm").distinct()), "page").select("norm", "s_norm").distinct()
    rated = texts.withColumn("similarity", similarity(F.col("norm"), F.col("s_norm")))
    pairs = nodes.join(_shuffled(s), "page").join(rated, ["norm", "s_norm"]).withColumn("distance", distance_ratio(Box.of("s_"), Box.of(), F.col("diagonal")))
    ok = (F.col("similarity") >= least) & (F.col("distance") <= radius)
    order = Window.partitionBy("page", "idx").orderBy(F.when(ok, 0).otherwise(1), F.col("similarity").desc(), F.col("distance"), F.col("span_idx"))
    top = pairs.withColumn("eligible", ok).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return top.select("page", "idx", "span_idx", "similarity", "distance", "eligible")


def match_nodes(nodes: DataFrame, spans: DataFrame, diagonals: DataFrame) -> DataFrame:
    """(page, idx, confidence, indices, similarity, sides): the match of every node.

    A chain or span of the same text is HIGH unless two are equally good, which leaves the
    node unmatched (LOW, no span). Nodes without any take the nearest fuzzy span: MEDIUM
    within the thresholds, else LOW.
    """
    n = with_neighbours(nodes).join(_shuffled(diagonals), "page")
    s = with_neighbours(spans)
    # Read by the exact result and by the anti join for the rest.
    exact = staged(exact_matches(n, span_chains(s)), "exact")
    rest = n.join(_shuffled(exact), ["page", "idx"], "left_anti")
    fuzzy = nearest_fuzzy(rest, s).join(_shuffled(s.select("page", F.col("idx").alias("span_idx"), *SIDES)), ["page", "span_idx"])
    found = exact.select(
        "page", "idx", F.when(F.col("unique"), "high").otherwise("low").alias("confidence"), F.when(F.col("unique"), F.col("indices")).alias("indices"),
        F.when(F.col("unique"), 1.0).otherwise(0.0).alias("similarity"), *[F.when(F.col("unique"), F.col(x)).alias(x) for x in SIDES],
    ).unionByName(
        fuzzy.select(
            "page", "idx", F.when(F.col("eligible"), "medium").otherwise("low").alias("confidence"), F.array("span_idx").alias("indices"), "similarity", *SIDES
        )
    )
    return nodes.select("page", "idx").join(_shuffled(found), ["page", "idx"], "left").withColumn("confidence", F.coalesce("confidence", F.lit("low")))
