"""Coverage of pages by a visual review, and the candidates it adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.classify import business_area
from marginalia.operators.spatial import duplicate_annotations

GROUPS = ("visible_groups", "required_groups", "checked_groups")


def _clean(items: Column) -> Column:
    """Unique, trimmed, not blank."""
    return F.forall(items, lambda x: (x != "") & (x == F.btrim(x))) & (F.size(F.array_distinct(items)) == F.size(items))


def page_errors(pages: DataFrame) -> DataFrame:
    """(page, code): the first rule that a reviewed page breaks.

    ``pages``: page, page_type, stage, business_area, protected (ids), existing (structs of
    item_id, should_translate), three colour-group arrays, width, height and boxes
    (structs of sides).
    """
    selected = F.transform(F.filter("existing", lambda e: e["should_translate"]), lambda e: e["item_id"])
    any_protected = F.size("protected") > 0
    visible, required, checked = (F.array_sort(F.array_distinct(g)) for g in GROUPS)
    complete = (F.size(visible) > 0) & (F.size(required) > 0) & (checked == required)
    covered = F.when(F.col("stage") == "development", F.size(F.array_except(required, visible)) == 0).otherwise(required == visible)
    bom = F.col("business_area") == "bom_color_groups"
    inside = F.forall("boxes", lambda b: (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= F.col("width")) & (b["y1"] <= F.col("height")))
    code = (
        F.when(F.col("business_area") != business_area(F.col("page_type")), "business_area")
        .when(~_clean(F.col("protected")), "protected_ids")
        .when(any_protected & ((F.col("page_type") != "print_artwork") | (F.size(F.array_except("protected", selected)) > 0)), "protected_items")
        .when(~(_clean(F.col(GROUPS[0])) & _clean(F.col(GROUPS[1])) & _clean(F.col(GROUPS[2]))), "group_names")
        .when(bom & ~complete, "groups_unchecked")
        .when(bom & ~covered, "groups_uncovered")
        .when(~bom & (F.size(F.concat(*GROUPS)) > 0), "groups_off_bom")
        .when(~inside, "outside_page")
    )
    return pages.select("page", code.alias("code")).where("code IS NOT NULL")


def supplements(annotations: DataFrame, existing: DataFrame) -> DataFrame:
    """Annotations (page, id, text, sides) that repeat no existing item, with item ids that
    continue after the largest number of their page.

    ``existing``: page, item_id, text, sides, should_translate; pages count from 0.
    """
    fresh = annotations.join(duplicate_annotations(annotations, existing).select("page", "id"), ["page", "id"], "left_anti")
    number = F.split_part("item_id", F.lit("i"), F.lit(-1)).cast("int")
    last = existing.groupBy("page").agg(F.max(number).alias("_last"))
    n = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("page").orderBy("id"))
    return fresh.join(last, "page", "left").withColumn("item_id", F.format_string("p%03d-i%03d", F.col("page") + 1, n)).drop("_last")
