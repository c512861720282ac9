"""Glossary: row validation, conflicts, compiled terms and leftmost-longest matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_term, placed

#: Up to so many terms the join with their probes is a broadcast.
BROADCAST_TERMS = 50_000
#: Letters of the first word of a term by which texts look for it.
PROBE = 6

# Accepted spellings of booleans.
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def parse_flag(value: Column) -> Column:
    """true, false, or null for an unknown spelling; blank is false."""
    word = F.lower(F.btrim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(word == "", False).when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def parse_priority(value: Column) -> Column:
    """An integer, 0 for blank, or null."""
    word = F.btrim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(word == "", 0).when(word.rlike(r"^[+-]?\d+\z"), word.try_cast("int"))


def row_errors(rows: DataFrame) -> DataFrame:
    """(row_number, error_code): the first failing check of each invalid row."""
    flag = parse_flag(F.col("do_not_translate"))
    code = (
        F.when(F.coalesce(normalize_term(F.col("source_term")), F.lit("")) == "", "source_term_empty")
        .when(flag.isNull(), "do_not_translate_invalid")
        .when(~flag & (F.btrim(F.coalesce("target_term", F.lit(""))) == ""), "target_term_empty")
        .when(parse_priority(F.col("priority")).isNull(), "priority_invalid")
    )
    return rows.select("row_number", code.alias("error_code")).where("error_code IS NOT NULL")


def entries(rows: DataFrame) -> DataFrame:
    """Parsed rows: terms trimmed, aliases split on '|', flags and priorities typed."""
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.btrim(a)), lambda a: a != "")
    return rows.select(
        "row_number",
        F.btrim("source_term").alias("source_term"),
        F.btrim(F.coalesce("target_term", F.lit(""))).alias("target_term"),
        aliases.alias("aliases"),
        parse_flag(F.col("do_not_translate")).alias("do_not_translate"),
        parse_priority(F.col("priority")).alias("priority"),
    )


def spellings(parsed: DataFrame) -> DataFrame:
    """One row per entry and spelling: the term itself, then its aliases in order."""
    spelled = F.posexplode(F.concat(F.array("source_term"), "aliases")).alias("alias_pos", "spelling")
    return parsed.select("*", spelled).withColumn("norm", normalize_term(F.col("spelling")))


def conflicts(parsed: DataFrame) -> DataFrame:
    """(norm, priority, do_not_translate, row_number): rows whose target differs from the
    one before under the same key."""
    key = Window.partitionBy("norm", "priority", "do_not_translate").orderBy("row_number", "alias_pos")
    seen = spellings(parsed).withColumn("before", F.lag("target_term").over(key))
    return seen.where("before <> target_term").select("norm", "priority", "do_not_translate", "row_number").distinct()


def terms(parsed: DataFrame) -> DataFrame:
    """Distinct (norm, target, priority, flag), the first entry of each winning."""
    key = Window.partitionBy("norm", "target_term", "priority", "do_not_translate").orderBy("row_number", "alias_pos")
    return (
        spellings(parsed).withColumn("_n", F.row_number().over(key)).where("_n = 1 AND norm <> ''")
        .select("source_term", "target_term", "norm", "priority", "do_not_translate")
    )


def pattern(norm: Column) -> Column:
    """Regular expression of a term: blanks stretch, dashes and slashes are optional
    connectors, and no word character continues it."""
    quoted = F.regexp_replace(norm, r"([\\.\[\]{}()*+?^$|#&~])", r"\\$1")
    joined = F.regexp_replace(quoted, r"\s*[-/]\s*", r"[\\s\\-/]*")
    return F.concat(F.lit(r"(?U)(?<!\w)"), F.replace(joined, F.lit(" "), F.lit(r"\s+")), F.lit(r"(?!\w)"))


def term_probe(norm: Column) -> Column:
    """The first letters of a term's first word, or its first character where it has no word.

    Whatever stands before that word in a match, no word character does: so a word of the
    text begins with these letters, also where connectors of the term are left out.
    """
    word = F.regexp_extract(norm, r"(?U)\w+", 0)
    return F.when(word != "", F.left(word, F.lit(PROBE))).otherwise(F.left(norm, F.lit(1)))


def text_probes(norm_text: Column) -> Column:
    """All probes that may find a term in a text: the beginnings of its words and its marks."""
    words = F.array_distinct(F.regexp_extract_all(norm_text, F.lit(r"(?U)\w+"), F.lit(0)))
    begun = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.least(F.char_length(w), F.lit(PROBE))), lambda n: F.left(w, n))))
    return F.array_distinct(F.concat(begun, F.regexp_extract_all(norm_text, F.lit(r"(?U)[^\w\s]"), F.lit(0))))


def hits(texts: DataFrame, compiled: DataFrame, key: str = "text_id") -> DataFrame:
    """(key, start, end, matched_text, source_term, target_term, priority, do_not_translate).

    ``texts`` has ``key`` and a normalised ``norm_text``. Matches are taken leftmost
    first, then longest, then do-not-translate, then by priority, source and target
    term; what overlaps a taken match is left. Distinct texts are matched once.
    """
    lexicon = compiled.withColumn("regex", pattern(F.col("norm"))).withColumn("probe", term_probe(F.col("norm")))
    if compiled.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        lexicon = F.broadcast(lexicon)
    unique = texts.select("norm_text").distinct()
    pairs = unique.select("norm_text", F.explode(text_probes(F.col("norm_text"))).alias("probe")).join(lexicon, "probe")
    order = F.struct(
        F.col("m.start").alias("start"), (F.col("m.start") - F.col("m.end")).alias("length"),
        (~F.col("do_not_translate")).alias("translated"), (-F.col("priority")).alias("rank"),
        F.lower("source_term").alias("folded"), F.col("target_term"), F.col("m.end").alias("end"), F.col("m.found").alias("matched_text"),
        F.col("source_term"), F.col("priority"), F.col("do_not_translate"),
    )
    found = pairs.select("norm_text", F.explode(placed(F.col("norm_text"), F.col("regex"))).alias("m"), "source_term", "target_term", "priority", "do_not_translate")
    ranked = found.groupBy("norm_text").agg(F.array_sort(F.collect_set(order)).alias("all"))
    none = F.slice("all", 1, 0)
    greedy = F.aggregate(
        "all", none, lambda acc, h: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > h["start"]), acc).otherwise(F.concat(acc, F.array(h)))
    )
    taken = ranked.select("norm_text", F.explode(greedy).alias("h"))
    return texts.select(key, "norm_text").join(taken.hint("merge"), "norm_text").select(
        key, "h.start", "h.end", "h.matched_text", "h.source_term", "h.target_term", "h.priority", "h.do_not_translate"
    )


def required_target(used: DataFrame, compiled: DataFrame) -> DataFrame:
    """(text_id, matched_text, target): target by source term, else by the matched spelling,
    else the hit's own."""
    table = compiled.groupBy("norm").agg(F.min("target_term").alias("t"))
    by_term = table.select(F.col("norm").alias("n1"), F.col("t").alias("t1"))
    by_match = table.select(F.col("norm").alias("n2"), F.col("t").alias("t2"))
    normal = used.withColumns({"_term": normalize_term(F.col("source_term")), "_match": normalize_term(F.col("matched_text"))})
    return (
        normal.join(by_term, F.col("_term") == F.col("n1"), "left")
        .join(by_match, F.col("_match") == F.col("n2"), "left")
        .select("text_id", "matched_text", F.coalesce("t1", "t2", "target_term").alias("target"))
    )
