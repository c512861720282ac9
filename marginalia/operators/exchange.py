"""Exchange with a translator: requests, hashes, response checks, trusted items, binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_term
from marginalia.functions.tokens import kept_values


def ordered_distinct(array: Column) -> Column:
    """Distinct elements in first-seen order."""
    return F.array_distinct(array)


def request_items(candidates: DataFrame) -> DataFrame:
    """Selected candidates as request rows: distinct term pairs in hit order and the mode.

    ``candidates``: item_id, should_translate, text, page_type, hits array of structs.
    """
    terms = ordered_distinct(F.transform("hits", lambda h: F.struct(h["source_term"].alias("source_term"), h["target_term"].alias("target_term"))))
    mode = F.when(F.col("page_type") == "sample_review", "faithful_digest").otherwise("direct")
    return candidates.where("should_translate").select("item_id", F.col("text").alias("source_text"), "page_type", terms.alias("glossary_terms"), mode.alias("mode"))


def canonical_json(*fields: str) -> Column:
    """One JSON object of the fields in alphabetical order, nulls kept. Strings and
    integers only: their spelling is the same everywhere."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def request_hash(*fields: str) -> Column:
    return F.sha2(canonical_json(*fields), 256)


def cache_key(pairs: Column, model: Column, job_id: Column, memory_digest: Column) -> Column:
    """Hash of the ordered pairs; the job counts only while the model is unknown."""
    parts = [F.array_join(pairs, "\u001f"), model, F.when(model == "unknown", job_id).otherwise(""), F.coalesce(memory_digest, F.lit(""))]
    return F.sha2(F.concat_ws("\u001e", *parts), 256)


def model_identifier(model: Column) -> Column:
    """Trimmed, any spelling of unknown in lower case, blank as null."""
    name = F.btrim(model)
    return F.when(name != "", F.when(F.lower(name) == "unknown", "unknown").otherwise(name))


def missing_items(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Requested ids without a response; all requested ids when none is missing."""
    gap = requested.join(returned, "item_id", "left_anti").select("item_id")
    everyone = requested.select("item_id")
    some = gap.agg((F.count(F.lit(1)) > 0).alias("some"))
    marked = everyone.join(gap.withColumn("gone", F.lit(True)), "item_id", "left").crossJoin(F.broadcast(some))
    return marked.where(~F.col("some") | F.col("gone")).select("item_id")


def failed_trusted(failed: DataFrame, trusted: DataFrame) -> DataFrame:
    """Failed ids that are trusted; all trusted ids when there is none."""
    both = trusted.join(failed, "item_id", "left_semi").select("item_id")
    some = both.agg((F.count(F.lit(1)) > 0).alias("some"))
    marked = trusted.select("item_id").join(both.withColumn("hit", F.lit(True)), "item_id", "left").crossJoin(F.broadcast(some))
    return marked.where(~F.col("some") | F.col("hit")).select("item_id")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): members of one side only; no rows means equal sets."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def multiset_mismatch(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """(key, n_left, n_right) where counts differ, absent counting as 0."""
    a = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*key).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, list(key), "full_outer").select(*key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> n_right")


def item_codes(pairs: DataFrame) -> DataFrame:
    """(item_id, codes): sorted failure codes of each response.

    ``pairs``: item_id, mode, r_mode, source_text, translated_text, locked, preserved, terms
    (source, target structs), used.
    """
    targets = F.filter("terms", lambda x: (x["target"] != "") & ~F.contains(normalize_term(F.col("translated_text")), normalize_term(x["target"])))
    kept = kept_values(F.col("locked"), F.col("translated_text"))
    wanted = F.transform("terms", lambda x: x["source"])
    codes = F.array(
        F.when(F.col("mode") != F.col("r_mode"), "mode_mismatch"),
        F.when((F.col("locked") != F.col("preserved")) | (F.col("locked") != kept), "locked_token_mismatch"),
        F.when(F.array_sort(wanted) != F.array_sort("used"), "glossary_terms_used_mismatch"),
        F.when(F.size(targets) > 0, "glossary_target_missing"),
    )
    return pairs.select("item_id", F.array_sort(F.array_compact(codes)).alias("codes"))


def response_outcome(checks: DataFrame) -> DataFrame:
    """(job_id, code): the first failing class in the order schema, attempt, binding,
    duplicate, id set, item; 'ok' when all hold. ``checks`` has one boolean per class."""
    order = ["schema", "attempt", "binding", "duplicate", "id_set", "item"]
    first = F.coalesce(*[F.when(~F.col(f"{c}_ok"), c) for c in order], F.lit("ok"))
    return checks.select("job_id", first.alias("code"))


def schema_code(field: Column) -> Column:
    return (
        F.when(F.contains(field, F.lit("translated_text")), "empty_translation")
        .when(F.contains(field, F.lit("translator.model")), "model_missing")
        .when(F.contains(field, F.lit("translator")), "translator_missing")
        .otherwise("response_schema_invalid")
    )


def correction_envelope(failures: DataFrame) -> DataFrame:
    """(job_id, attempt, item_ids, codes, next_state): sorted ids and codes of each job; a
    second failure needs a person."""
    return failures.groupBy("job_id", "attempt").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.array_sort(F.collect_set("code")).alias("codes")
    ).withColumn("next_state", F.when(F.col("attempt") == 0, "host_correction").otherwise("human_review_required"))


def trusted_items(candidates: DataFrame, translations: DataFrame) -> DataFrame:
    """Selected candidates with their translation; ``missing`` marks an absent one."""
    t = translations.select("item_id", "translated_text", F.lit(True).alias("_t"))
    return candidates.where("should_translate").join(t, "item_id", "left").withColumn("missing", F.col("_t").isNull()).drop("_t")


def with_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages whose type was pending take the answer of their page, others stay."""
    a = answers.select("page_id", F.col("page_type").alias("_type"), F.col("confidence").alias("_conf"))
    pending = F.col("page_type") == "unknown"
    return pages.join(a, "page_id", "left").select(
        "page_id", F.when(pending, F.coalesce("_type", "page_type")).otherwise(F.col("page_type")).alias("page_type"),
        F.when(pending, F.coalesce("_conf", "confidence")).otherwise(F.col("confidence")).alias("confidence"),
    )


def bijection_errors(request: DataFrame, response: DataFrame, key: str) -> DataFrame:
    """(key, error): keys of one side only, and keys the response repeats."""
    n = response.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = request.select(key, F.lit(True).alias("q")).distinct().join(n, key, "full_outer")
    error = F.when(F.col("q").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return both.select(key, error.alias("error")).where("error IS NOT NULL")


def next_item_number(items: DataFrame) -> DataFrame:
    """(page, next_number): one past the largest item number of each page."""
    number = F.split_part("item_id", F.lit("i"), F.lit(-1)).cast("int")
    return items.groupBy("page").agg((F.max(number) + 1).alias("next_number"))


def key_errors(objects: DataFrame, expected: list[str]) -> DataFrame:
    """(id, extra, missing): JSON objects whose keys are not exactly the expected ones."""
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    want = F.array(*[F.lit(k) for k in expected])
    out = objects.select("id", F.array_sort(F.array_except(keys, want)).alias("extra"), F.array_sort(F.array_except(want, keys)).alias("missing"))
    return out.where((F.size("extra") > 0) | (F.size("missing") > 0))


def drifted(bound: DataFrame, now: DataFrame) -> DataFrame:
    """(name, state): artifacts whose digest changed or is gone since they were bound."""
    n = now.select("name", F.col("digest").alias("_now"))
    both = bound.join(n, "name", "left").where(~F.col("digest").eqNullSafe(F.col("_now")))
    return both.select("name", F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("state"))


def ordered_equal(left: DataFrame, right: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, same): whether the values of a group are the same in the same order."""
    fold = lambda d, name: d.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias(name))
    both = fold(left, "a").join(fold(right, "b"), group, "full_outer")
    only = lambda c: F.transform(c, lambda x: x[value])
    return both.select(group, only("a").eqNullSafe(only("b")).alias("same"))


def first_seen(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
