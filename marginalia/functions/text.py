"""Text normalisation, comparison and occurrence counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic dashes, slashes and quotes and what they read as.
PUNCTUATION = {
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-",
    "\u2044": "/", "\u2215": "/",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
}
_FROM, _TO = "".join(PUNCTUATION), "".join(PUNCTUATION.values())


def collapse(text: Column) -> Column:
    """Runs of Unicode whitespace become one blank, none at the ends; case is kept."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _unfolded(text: Column) -> Column:
    return collapse(F.translate(text, _FROM, _TO))


def normalize_term(text: Column) -> Column:
    """Comparison form: compatibility composition, punctuation unified, blanks collapsed,
    case folded in full.

    Inside the JVM: other texts than ASCII go through the Unicode library that Spark
    brings for its collations; for ASCII lower case is the same.
    """
    other = F.coalesce(F.octet_length(text) != F.char_length(text), F.lit(False))
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.when(other, text).otherwise(""), F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _unfolded(composed), F.lit(True))
    return F.when(other, folded).otherwise(F.lower(collapse(text)))


def source_key(text: Column) -> Column:
    """Key of a remembered source text."""
    return collapse(text)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table per character of ``a``."""
    letters_b = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.char_length(b)), lambda _: F.lit(0))

    def row(previous: Column, letter: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.get(letters_b, j) == letter, F.get(previous, j) + 1).otherwise(
                F.greatest(F.get(previous, j + 1), F.element_at(done, -1))
            )
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(0), F.char_length(b) - 1), F.array(F.lit(0)), cell)

    full = F.aggregate(F.split(a, ""), zero, row, lambda x: F.element_at(x, -1))
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), 0).otherwise(full)


def similarity(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b): 1 for equal texts, two empty texts included."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_subsequence(a, b) / total)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return F.when(
        F.char_length(part) > 0,
        ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int"),
    ).otherwise(0)


def placed(text: Column, regex: Column) -> Column:
    """Array of (start, end, found) of all matches: gaps between them come from a split."""
    gaps = F.transform(F.split(text, regex, F.lit(-1)), lambda g: F.char_length(g))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        end = start + F.char_length(p["m"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("found")))).alias("out"),
        )

    def read(found: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step, lambda acc: acc["out"])).when(F.size(found) == 0, empty["out"])

    return let(F.regexp_extract_all(text, regex, F.lit(0)), read)


#: Noncharacters that mark the beginning and the ends of matches; no text should hold them.
_BEGIN, _END, _LAST = "\ufdd0", "\ufdd1", "\ufdd2"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, which expressions in lambdas are not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def marked(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, found, value) of all matches of a pattern that is never empty;
    ``value`` is a group of each. The pattern is applied once: marks put around its matches
    tell them from the gaps. A text with such marks in it is searched as :func:`placed` does."""
    put = f"{_BEGIN}$0{_END}${group}{_LAST}"
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(put)), _BEGIN)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,found:string,value:string>>)").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        found, rest = F.substring_index(part, _END, 1), F.substring_index(part, _END, -1)
        value, gap = F.substring_index(rest, _LAST, 1), F.substring_index(rest, _LAST, -1)
        end = acc["at"] + F.char_length(found)
        row = F.struct(acc["at"].alias("start"), end.alias("end"), found.alias("found"), value.alias("value"))
        return F.struct((end + F.char_length(gap)).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def read(p: Column) -> Column:
        first = F.struct(F.char_length(F.get(p, F.lit(0))).alias("at"), empty["out"].alias("out"))
        return F.when(F.size(p) > 1, F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), first, step, lambda acc: acc["out"])).otherwise(empty["out"])

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    slow = F.zip_with(
        placed(text, F.lit(pattern)), values, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), v.alias("value"))
    )
    return F.when(text.rlike(f"[{_BEGIN}{_END}{_LAST}]"), slow).otherwise(let(parts, read))


def literal_places(text: Column, value: Column) -> Column:
    """Array of (start, end, found) where a value that is not empty stands in a text, from
    the left, none inside another; no pattern is made of it."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")

    def step(acc: Column, gap: Column) -> Column:
        end = acc["at"] + F.char_length(value)
        row = F.struct(acc["at"].alias("start"), end.alias("end"), value.alias("found"))
        return F.struct((end + F.char_length(gap)).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def read(p: Column) -> Column:
        first = F.struct(F.char_length(F.get(p, F.lit(0))).alias("at"), empty.alias("out"))
        return F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), first, step, lambda acc: acc["out"])

    slow = placed(text, F.regexp_replace(value, r"([^\p{L}\p{N}])", r"\\$1"))
    fast = let(F.split(F.replace(text, value, F.lit(_BEGIN)), _BEGIN), read)
    return F.when((value == "") | text.contains(_BEGIN), slow).when(~text.contains(value), empty).otherwise(fast)


def escape_cell(text: Column) -> Column:
    """A text as one cell of a Markdown table."""
    # Replacements in their order.
    for old, new in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("|", "&#124;"),
        ("\r\n", "&#13;<br>"), ("\n", "<br>"), ("\r", "&#13;"),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape_cell(text: Column) -> Column:
    """The text of a cell written by :func:`escape_cell`."""
    for old, new in (
        ("<br>", "\n"), ("&#13;", "\r"), ("&#124;", "|"), ("&#x27;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def zoned_timestamp(text: Column) -> Column:
    """An ISO timestamp that states its zone, else null."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))
