"""Page classification by staged rules, stage of the job, business areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_term

# Page type and the phrases of its titles.
TITLES = {
    "general_info": ("style general information", "general information"),
    "bom": ("bill of materials", "bom"),
    "measurement": ("measurement sheet", "size chart"),
    "technical_drawing": ("style additional images", "technical drawing", "cad drawing"),
    "print_artwork": ("print artwork", "print art", "print layout"),
    "label_pack": ("label and pack", "label pack", "packaging information", "packing information"),
    "sample_review": (
        "sample style review", "sample review", "customer comments", "customer comment", "buyer comments", "client comments",
    ),
    "style_sample": ("style sample", "fit page"),
    "how_to_measure": ("how to measure",),
    "construction_detail": ("construction detail",),
    "category_fields": ("style category fields", "category fields"),
}
# Business area by page type.
AREAS = {
    "technical_drawing": "cad_technical_details",
    "construction_detail": "cad_technical_details",
    "bom": "bom_color_groups",
    "measurement": "measurement_table",
    "sample_review": "customer_comments",
    "style_sample": "customer_comments",
    "print_artwork": "print_artwork",
    "label_pack": "packaging_information",
}
DEVELOPMENT = (
    r"(?i)(?:\bstage\s*[:\-]?\s*development\b|\bdevelopment\s+(?:stage|phase)\b|\bsample\s+development\b|开发阶段)"
)
BULK = (
    r"(?i)(?:\bstage\s*[:\-]?\s*bulk\b|\bbulk(?:[-\s]+production)?\s+(?:stage|phase)\b"
    r"|\bbulk[-\s]+production\b|大货阶段|量产阶段)"
)


def has_phrase(text: Column, *phrases: str) -> Column:
    return text.rlike(r"(?U)(?<!\w)(?:" + "|".join(phrases) + r")(?!\w)")


def title_types(title: Column) -> Column:
    norm = normalize_term(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(*[F.when(has_phrase(norm, *p), t) for t, p in TITLES.items()]))


def _normal_set(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), normalize_term)


def header_types(headers: Column) -> Column:
    found = _normal_set(headers)
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    measured = F.size(F.array_except(words("pom", "description", "tolerance"), found)) == 0
    extras = F.size(F.array_intersect(words("composition", "weight", "supplier", "component"), found))
    return F.array_compact(
        F.array(F.when(measured, "measurement"), F.when(F.array_contains(found, "material") & (extras >= 2), "bom"))
    )


def visual_types(features: Column) -> Column:
    found = _normal_set(features)
    both = lambda a, b: F.array_contains(found, a) & F.array_contains(found, b)
    return F.array_compact(
        F.array(
            F.when(both("technical drawing", "callout arrows"), "technical_drawing"),
            F.when(both("sample photos", "review annotations"), "sample_review"),
        )
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (title, headers, features, agent struct<page_type, confidence, evidence>)
    plus page_type, confidence, stage.

    The first stage with a rule that holds decides: one type wins, several are a
    conflict. Conflicts and pages without any rule take the agent's answer if it is
    known, at least 0.80 sure and has evidence; else they stay unknown and pending.
    """
    staged = pages.withColumns(
        {"_t": title_types(F.col("title")), "_h": header_types(F.col("headers")), "_v": visual_types(F.col("features"))}
    )
    first = F.when(F.size("_t") > 0, F.col("_t")).when(F.size("_h") > 0, F.col("_h")).otherwise(F.col("_v"))
    sure = F.when(F.size("_t") > 0, 1.0).when(F.size("_h") > 0, 0.95).otherwise(0.9)
    stage = F.when(F.size("_t") > 0, "title").when(F.size("_h") > 0, "table").when(F.size("_v") > 0, "visual")
    agent = F.col("agent")
    usable = F.coalesce(
        (agent["confidence"] >= 0.8)
        & (agent["page_type"] != "unknown")
        & (F.size(F.filter(agent["evidence"], lambda e: F.btrim(e) != "")) > 0),
        F.lit(False),
    )
    one = F.size("_f") == 1
    return (
        staged.withColumns({"_f": first, "_s": sure, "_g": stage})
        .withColumn("page_type", F.when(one, F.col("_f")[0]).when(usable, agent["page_type"]).otherwise("unknown"))
        .withColumn("confidence", F.when(one, F.col("_s")).otherwise(F.coalesce(agent["confidence"], F.lit(0.0))))
        .withColumn(
            "stage",
            F.when(one, F.col("_g")).when(usable, "agent").when(F.size("_f") > 1, "conflict").otherwise("pending"),
        )
        .drop("_t", "_h", "_v", "_f", "_s", "_g")
    )


def known_jobs(pages: DataFrame) -> DataFrame:
    """(job_id, accepted): whether a page of the job has a known type and nonblank evidence."""
    shown = F.exists("evidence", lambda e: F.btrim(e) != "") & (F.col("page_type") != "unknown")
    return pages.groupBy("job_id").agg(F.coalesce(F.bool_or(shown), F.lit(False)).alias("accepted"))


def stage_binding(nodes: DataFrame) -> DataFrame:
    """(job_id, stage, evidence): development or bulk when only one is named in the job's
    texts, else ambiguous; evidence lists distinct texts in first-seen order."""
    text = F.btrim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    named = nodes.select("job_id", "ord", text.alias("text")).select(
        "*", F.col("text").rlike(DEVELOPMENT).alias("dev"), F.col("text").rlike(BULK).alias("bulk")
    ).where("dev OR bulk")
    first = named.groupBy("job_id", "text").agg(F.min("ord").alias("ord"), F.max("dev").alias("dev"), F.max("bulk").alias("bulk"))
    listed = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col(kind), F.struct("ord", "text")))), lambda x: x["text"]
    )
    found = first.groupBy("job_id").agg(listed("dev").alias("d"), listed("bulk").alias("b"))
    jobs = nodes.select("job_id").distinct().join(found, "job_id", "left")
    d, b = F.coalesce(F.size("d"), F.lit(0)), F.coalesce(F.size("b"), F.lit(0))
    stage = F.when((d > 0) & (b <= 0), "development").when((b > 0) & (d <= 0), "bulk").otherwise("ambiguous")
    none = F.array().cast("array<string>")
    return jobs.select("job_id", stage.alias("stage"), F.concat(F.coalesce("d", none), F.coalesce("b", none)).alias("evidence"))


def business_area(page_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])
    return F.coalesce(table[page_type], F.lit("supplemental"))
