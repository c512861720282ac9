"""Selection of candidate texts with explainable reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import tokens
from marginalia.functions.text import normalize_term

# Field roles and labels by what they mean for selection.
ADMIN_ROLES = (
    "admin", "administrative", "category_field", "header", "footer", "header_footer", "page_number", "system_field",
    "table_header", "template_title", "retained_table_value",
)
ROLES = {
    "bom": ("body", "material", "composition", "weight", "use", "component", "process_note", "placement"),
    "measurement": (
        "body", "pom_description", "measurement_instruction", "style_measurement_instruction", "description", "note",
    ),
    "technical_drawing": ("body", "production_instruction", "callout", "construction_instruction"),
    "print_artwork": (
        "body", "production_instruction", "placement", "color_note", "artwork_text", "callout", "note", "description",
    ),
    "label_pack": ("body", "name", "sequence", "folding_instruction", "position", "operation_instruction"),
    "construction_detail": ("body", "production_instruction", "actionable_instruction", "instruction"),
}
REVIEW_ROLES = (
    "body", "issue", "conclusion", "exception", "action", "fit_issue", "correction", "caption", "description", "note",
)
ACTIONABLE = ("issue", "conclusion", "exception", "action", "fit_issue", "correction")
REVIEW_PAGES = ("sample_review", "style_sample")
GENERAL_NOTES = ("special_note", "production_note", "delivery_note")
ARTWORK_PROTECTED = ("trademark", "brand", "brand_name", "logo", "nonlinguistic_graphic", "artwork_code", "dimension")
ADMIN_LABELS = (
    "approval status", "base size", "category", "code", "color", "default", "description", "designer", "dimension",
    "division", "expiration date", "grade rule", "label", "label and pack", "last location", "last location date",
    "measurement", "measurement type", "part", "quantity", "received on", "request number", "requested on", "required by",
    "sample id", "sample type", "season", "shipped on", "size", "size class", "sourcing", "stage", "step", "style",
    "tech designer", "tracking number", "vendor",
)
ADMIN_EXACT = ("fit notes",)
ADMIN_TITLES = (
    "bill of material", "construction detail", "how to measure guide", "measurement sheet", "sample style review",
    "style additional images", "style category fields", "style general information", "style sample",
)


def role_rules(spark) -> DataFrame:
    """(page_type, role, base_reason): which roles of which pages are translated, and why."""
    rows = [(p, r, "page_rule" if r == "body" else "field_rule") for p, roles in ROLES.items() for r in roles]
    rows += [
        (p, r, "actionable_review" if r in ACTIONABLE else "page_rule") for p in REVIEW_PAGES for r in REVIEW_ROLES
    ]
    return spark.createDataFrame(rows, "page_type string, role string, base_reason string")


def normal_role(role: Column) -> Column:
    return F.replace(normalize_term(role), F.lit(" "), F.lit("_"))


def is_administrative(norm: Column, role: Column) -> Column:
    """Titles and labels of the form itself, and values that stand behind such a label."""
    label = F.btrim(F.substring_index(norm, ":", 1))
    value = F.when(norm.contains(":"), F.btrim(F.substring(norm, F.locate(":", norm) + 1, F.char_length(norm)))).otherwise("")
    bare = F.btrim(F.rtrim(F.btrim(norm), F.lit(":")))
    described = (label == "description") & (role == "description") & (value != "")
    return (
        norm.isin(*ADMIN_TITLES, *ADMIN_EXACT)
        | norm.startswith(":")
        | bare.isin(*ADMIN_LABELS)
        | ((label == "notes") & (value == ""))
        | (label.isin(*ADMIN_LABELS) & ~described)
        | (~label.isin(*ADMIN_LABELS) & norm.endswith(":") & norm.startswith("season "))
    )


def is_protected_mark(page_type: Column, role: Column, text: Column) -> Column:
    short = (page_type == "technical_drawing") & (role == "body") & F.btrim(text).rlike(r"^[A-Z]{2,6}\.\z")
    return short | ((page_type == "print_artwork") & role.isin(*ARTWORK_PROTECTED))


def upgrade(base: Column) -> Column:
    """Glossary hit before mixed text before the rule's own reason."""
    return F.when(F.col("n_hits") > 0, "glossary_hit").when((F.col("n_tokens") > 0) & ~F.col("code_only"), "mixed_text").otherwise(base)


def decide(rows: DataFrame) -> DataFrame:
    """``rows`` plus should_translate, reason.

    Needs page_id, pos, page_type, confidence, role (normal form), text, norm, code_only,
    pure_dimension, n_tokens, n_hits. A text that repeats a selected text of its page is a
    duplicate; the first eligible row of a text is always the selected one, so the
    condition is a running count over the page.
    """
    spark = rows.sparkSession
    ruled = rows.join(F.broadcast(role_rules(spark)), ["page_type", "role"], "left")
    page, role = F.col("page_type"), F.col("role")
    early = (
        F.when((page == "unknown") | (F.col("confidence") < 0.8), "low_confidence")
        .when((F.col("norm") == "") | role.isin(*ADMIN_ROLES), "skipped_admin")
        .when(is_protected_mark(page, role, F.col("text")) | F.col("pure_dimension") | F.col("code_only"), "skipped_code")
        .when(is_administrative(F.col("norm"), role), "skipped_admin")
        .when((page == "how_to_measure") & (role == "special_measurement_instruction"), "+")
        .when(page.isin("how_to_measure", "category_fields"), "skipped_admin")
        .when((page == "general_info") & role.isin(*GENERAL_NOTES), "+")
        .when(page == "general_info", "skipped_admin")
    )
    staged = ruled.withColumn("_early", early)
    eligible = F.coalesce(F.col("_early") == "+", F.lit(False)) | (F.col("_early").isNull() & F.col("base_reason").isNotNull())
    staged = staged.withColumn("_eligible", eligible)
    above = Window.partitionBy("page_id", "norm").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    repeated = F.coalesce(F.count_if("_eligible").over(above), F.lit(0)) > 0
    reason = (
        F.when(F.col("_early") == "+", upgrade(F.lit("field_rule")))
        .when(F.col("_early").isNotNull(), F.col("_early"))
        .when(repeated, "skipped_duplicate")
        .when(F.col("base_reason").isNull(), "manual_candidate")
        .otherwise(upgrade(F.col("base_reason")))
    )
    chosen = F.col("reason").isin("page_rule", "field_rule", "glossary_hit", "actionable_review", "mixed_text")
    return staged.withColumn("reason", reason).withColumn("should_translate", chosen).drop("_early", "_eligible", "base_reason")


def item_ids(rows: DataFrame) -> DataFrame:
    """``rows`` plus item_id, pNNN-iNNN by page and 1-based position in it."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.withColumn("item_id", F.format_string("p%03d-i%03d", F.col("page_id") + 1, n))


def select_candidates(nodes: DataFrame, compiled_terms: DataFrame) -> DataFrame:
    """Nodes (page_id, pos, page_type, confidence, role, text, coordinate_confidence) to
    candidates with ids, locked tokens, glossary hits, decisions and approval flags."""
    from marginalia.operators import glossary

    rows = item_ids(nodes).withColumns({"norm": normalize_term(F.col("text")), "role": normal_role(F.col("role"))})
    found = glossary.hits(rows.select(F.col("item_id").alias("text_id"), F.col("norm").alias("norm_text")), compiled_terms)
    by_item = found.groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "matched_text", "source_term", "target_term", "priority", "do_not_translate"))).alias("hits")
    ).withColumnRenamed("text_id", "item_id")
    joined = rows.join(by_item.hint("merge"), "item_id", "left").withColumn("locked", tokens.lock_tokens(F.col("text")))
    ready = joined.withColumns(
        {
            "code_only": tokens.is_code_only(F.col("text"), F.col("locked"), F.col("norm")),
            "pure_dimension": tokens.is_pure_dimension(F.col("text")),
            "n_tokens": F.size("locked"),
            "n_hits": F.coalesce(F.greatest(F.size("hits"), F.lit(0)), F.lit(0)),
        }
    )
    done = decide(ready)
    auto = F.col("should_translate") & (F.col("coordinate_confidence") == "high") & (F.col("confidence") >= 0.8)
    return done.withColumn("auto_approvable", auto)
