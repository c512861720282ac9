"""Review: navigation, counters, provenance, validation of a completed review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_term, occurrences

RISKS = ("high", "medium", "low")


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "high", 0).when(risk == "medium", 1).when(risk == "low", 2).otherwise(3)


def final_text(item_status: Column, reviewed: Column, suggested: Column) -> Column:
    return F.coalesce(F.when(item_status == "approved_edited", reviewed).otherwise(suggested), F.lit(""))


def set_status(status: Column, reviewed: Column, suggested: Column) -> Column:
    """Approval of a changed text is an edited approval."""
    changed = F.btrim(F.coalesce(reviewed, F.lit(""))) != F.btrim(F.coalesce(suggested, F.lit("")))
    return F.when((status == "approved") & changed, "approved_edited").otherwise(status)


def navigation(items: DataFrame) -> DataFrame:
    """One row per page: item ids in review order, counts by risk, the highest risk and
    whether one of it is still open, and the place of the page in the list.

    ``items``: page, item_id, ord, open, risk. Open items come first, then by risk.
    """
    order = F.struct(F.when(F.col("open"), 0).otherwise(1).alias("a"), risk_rank(F.col("risk")).alias("b"), "ord", "item_id")
    top = F.min(risk_rank(F.col("risk"))).over(Window.partitionBy("page"))
    marked = items.withColumn("_top", top)
    pages = marked.groupBy("page").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item_id"]).alias("item_ids"),
        F.count_if("open").alias("unreviewed"),
        *[F.count_if(F.col("risk") == r).alias(f"n_{r}") for r in RISKS],
        F.min("_top").alias("top"),
        F.bool_or(F.col("open") & (risk_rank(F.col("risk")) == F.col("_top"))).alias("open_at_top"),
    )
    risk = F.when(F.col("top") == 0, "high").when(F.col("top") == 1, "medium").otherwise("low")
    return pages.withColumn("highest_risk", risk).drop("top")


def queue(items: DataFrame) -> DataFrame:
    """Open items by risk, page and order."""
    return items.where("open").orderBy(risk_rank(F.col("risk")), "page", "ord")


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def single_or_mixed(*columns: str) -> list[Column]:
    """The only value of each column, 'mixed' for several."""
    return [F.when(F.count_distinct(c) == 1, F.min(c)).otherwise("mixed").alias(c) for c in columns]


def warnings(native_only: Column, confidence: Column, model: Column, placed: Column) -> Column:
    """Distinct quality warnings in their fixed order."""
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(native_only, "native_only_degradation"), F.when(confidence != "high", "coordinate_confidence"),
                F.when(model == "unknown", "unknown_model"), F.when(~placed, "manual_placement_required"),
            )
        )
    )


def risk_level(listed: Column, auto: Column) -> Column:
    return F.when((F.size(listed) > 0) | ~auto, "high").otherwise("low")


def visible(items: DataFrame, page=None, status=None, risk=None, search=None, with_issue=None) -> DataFrame:
    """Items that pass every filter that is given."""
    out = items
    for value, test in (
        (page, lambda v: F.col("page") == v), (status, lambda v: F.col("status") == v), (risk, lambda v: F.col("risk") == v),
        (search, lambda v: F.contains(F.lower("reviewed"), F.lit(v.lower()))), (with_issue, lambda v: F.col("issue") == v),
    ):
        if value is not None:
            out = out.where(test(value))
    return out


def frozen(items: DataFrame, *fields: str) -> DataFrame:
    """Approved items take the reviewed value of a field, or else freeze the current one."""
    approved = F.col("status").isin("approved", "approved_edited")
    return items.withColumns({f"reviewed_{f}": F.when(approved, F.coalesce(f"reviewed_{f}", f)).otherwise(F.col(f"reviewed_{f}")) for f in fields})


def changed_items(review: DataFrame, trusted: DataFrame, immutable: list[str]) -> DataFrame:
    """(item_id, error): missing, unexpected, and items with a changed immutable field."""
    a = review.select("item_id", F.struct(*immutable).alias("a"), F.lit(True).alias("in_a"))
    b = trusted.select("item_id", F.struct(*immutable).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "item_id", "full_outer")
    error = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_b").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("item_id", error.alias("error")).where("error IS NOT NULL")


def first_violation(items: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(item_id, check_ord, code): the first check of each item that does not hold."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("check_ord"), F.lit(code).alias("code"))) for i, (code, ok) in enumerate(checks)])
    return items.select("item_id", failed.alias("v")).where("v IS NOT NULL").select("item_id", "v.check_ord", "v.code")


def translation_errors(items: DataFrame) -> DataFrame:
    """(item_id, code): do-not-translate terms first, then locked tokens, then targets.

    ``items``: item_id, source, final, dnt, locked, targets (arrays of strings).
    """
    counted = F.exists("dnt", lambda d: occurrences(F.col("source"), d) != occurrences(F.col("final"), d))
    lost = F.exists("locked", lambda x: ~F.contains(F.col("final"), x))
    absent = F.exists("targets", lambda x: ~F.contains(normalize_term(F.col("final")), normalize_term(x)))
    code = F.when(counted, "do_not_translate_changed").when(lost, "locked_token_changed").when(absent, "glossary_target_missing")
    return items.select("item_id", code.alias("code")).where("code IS NOT NULL")


def geometry_errors(items: DataFrame, width: float, height: float) -> DataFrame:
    """Approved items whose frozen layout is incomplete, off the page or of a bad font."""
    approved = F.col("status").isin("approved", "approved_edited")
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= width) & (F.col("y1") <= height) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    finite = ~F.isnan("x0") & ~F.isnan("y1")
    leader = F.col("leader").isNull() | F.size("leader").isin(4, 6)
    return first_violation(items.where(approved), [("not_finite", finite), ("outside_page", inside), ("font", F.col("font").between(5, 24)), ("leader", leader)])


def explanations(items: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """(item_id, explanation): label of the reason, a default for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    return items.select("item_id", F.coalesce(table[F.col("reason")], F.lit("confirm")).alias("explanation"))


def redacted(details: Column, allowed: tuple[str, ...], sensitive: tuple[str, ...]) -> Column:
    return F.map_filter(details, lambda k, v: k.isin(*allowed) & ~k.isin(*sensitive))
