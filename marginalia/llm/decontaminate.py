"""Benchmark decontamination with a distributed positional inverted index.

Native only. The corpus is tokenised once to count the benchmark's terms; each phrase
is then anchored on its rarest terms, and the index stores the postings (term, document,
position) of those terms alone. A phrase may occur where the offset-adjusted posting
lists of its rarest terms intersect; the few places left are confirmed against the words
of their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import alnum_words, bounded_broadcast, discard, materialize, small_enough, text_or_empty

#: Words in a window.
WINDOW = 10
#: Copies of the anchors over which postings are dealt where the anchors are not broadcast.
SALTS = 32
KEY = ["doc_id", "text_h"]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_h"), text_or_empty().alias("text"))


def _tokens(docs: DataFrame) -> DataFrame:
    return _texts(docs).select(*KEY, alnum_words(F.col("text")).alias("words"))


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    """Rows with a null doc_id are told apart by their text."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_h"] == right["text_h"])


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, gram long, terms array): every window of every item.

    An item shorter than ``window`` is one window; an item without words has none.
    ``gram`` is a hash of the terms by which candidates are grouped.
    """
    words = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), alnum_words(text_or_empty()).alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    grams = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms"))
    return grams.select("item_id", F.xxhash64("terms").alias("gram"), "terms").distinct()


def anchor_terms(docs: DataFrame, phrases: DataFrame, n_rarest: int = 2) -> DataFrame:
    """(gram, need, rank, off, term): the ``n_rarest`` rarest places of each phrase; ``need``
    has the bits of all its ranks.

    Phrases with a term that no document has are left out: they cannot occur. Counts of a
    term are summed inside each task before they are shuffled.
    """
    unique = phrases.select("gram", "terms").distinct()
    slots = unique.select("gram", "terms", F.posexplode("terms").alias("off", "term"))
    vocabulary = bounded_broadcast(slots.select("term").distinct())
    seen = _tokens(docs).select(F.explode("words").alias("term"))
    counts = seen.join(vocabulary, "term", "left_semi").groupBy("term").count()
    by_phrase = Window.partitionBy("gram", "terms")
    ranked = (
        slots.join(counts, "term", "left")
        .withColumn("n", F.coalesce("count", F.lit(0)))
        .withColumn("least", F.min("n").over(by_phrase))
        .where("least > 0")
        .withColumn("rank", F.row_number().over(by_phrase.orderBy("n", "off")))
    )
    need = F.pow(F.lit(2), F.least(F.size("terms"), F.lit(n_rarest))).cast("int") - 1
    return ranked.where(F.col("rank") <= n_rarest).select("gram", need.alias("need"), "rank", "off", "term")


def build_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional postings (term, doc_id, text_h, pos) of ``terms``."""
    placed = _tokens(docs).select(*KEY, F.posexplode("words").alias("pos", "term"))
    return placed.join(bounded_broadcast(terms.select("term").distinct()), "term", "left_semi").select("term", *KEY, "pos")


def _listed(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings with every anchor they serve. A frequent term's list is dealt over salts
    where the anchors are too many to broadcast."""
    small = bounded_broadcast(anchors)
    if small is not anchors:
        return postings.join(small, "term")
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64(*KEY, "pos"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def candidate_places(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, text_h, places): (gram, start) where the offset-adjusted lists of all
    anchors of a phrase intersect."""
    start = _listed(postings, anchors).withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    bits = F.bit_or(F.pow(F.lit(2), F.col("rank") - 1).cast("int"))
    met = start.groupBy("gram", *KEY, "start").agg(bits.alias("bits"), F.max("need").alias("need")).where("bits = need")
    return met.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "start")).alias("places"))


def _read_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text_h, words, gram, place...) of the documents that have places; they alone
    are read as words again."""
    texts = _texts(docs)
    wanted = F.broadcast(places) if small_enough(places, size_of=16 * F.size("places") + 32) else places
    read = texts.join(wanted, _same_document(texts, places)).select(
        texts["doc_id"], texts["text_h"], alnum_words(texts["text"]).alias("words"), "places"
    )
    return read.select(*KEY, "words", F.inline("places"))


def phrase_matches(docs: DataFrame, phrases: DataFrame, places: DataFrame) -> DataFrame:
    """Exact occurrences (gram, terms, doc_id, text_h, start) among the candidate places.

    Each is confirmed word by word, so equal hashes of different phrases do no harm.
    """
    each = _read_places(docs, places)
    grams = bounded_broadcast(phrases.select("gram", "terms").distinct())
    exact = each.join(grams, "gram").where(F.slice("words", F.col("start") + 1, F.size("terms")) == F.col("terms"))
    return exact.select("gram", "terms", *KEY, "start").distinct()


def proximity_matches(docs: DataFrame, phrases: DataFrame, postings: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(gram, terms, doc_id, text_h, pos): all terms of the phrase, in any order, within
    ``n_terms + slop`` consecutive words that hold its rarest term at ``pos``."""
    at = _listed(postings, anchors.where("rank = 1")).groupBy(*KEY).agg(F.collect_set(F.struct("gram", "pos")).alias("places"))
    each = _read_places(docs, at).join(bounded_broadcast(phrases.select("gram", "terms").distinct()), "gram")
    span = F.size("terms") + slop
    starts = F.sequence(F.greatest(F.col("pos") - span + 1, F.lit(0)), F.col("pos"))
    close = F.exists(starts, lambda s: F.size(F.array_except("terms", F.slice("words", s + 1, span))) == 0)
    return each.where(close).select("gram", "terms", *KEY, "pos").distinct()


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_h, n_hit, n_items, item_ids): documents with an occurring window.

    Items with a null item_id have no name to report and take no part. Documents with a
    null doc_id are told apart by their text.
    """
    phrases = materialize(phrases_of(items, window), "phrases")
    anchors = materialize(anchor_terms(docs, phrases), "anchors")
    postings = materialize(build_postings(docs, anchors), "postings")
    places = materialize(candidate_places(postings, anchors), "places")
    discard(postings, anchors)
    found = materialize(phrase_matches(docs, phrases, places), "matches")
    discard(places)
    covered = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.size("terms") - 1)).alias("at"))
    n_hit = covered.distinct().groupBy(*KEY).agg(F.count("at").alias("n_hit"))
    listed = found.select(*KEY, "gram", "terms").distinct().join(bounded_broadcast(phrases), ["gram", "terms"])
    ids = listed.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return n_hit.join(ids, _same_document(n_hit, ids)).select(
        n_hit["doc_id"], n_hit["text_h"], "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Repeated rows get the same result each; rows with
    a null doc_id are documents like any other. Without items nothing is contaminated.
    """
    base = docs.select("doc_id", "text")
    counted = _texts(base).select(*KEY, F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    hits = benchmark_hits(base, items, window)
    return counted.join(hits, _same_document(counted, hits), "left").select(
        counted["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
