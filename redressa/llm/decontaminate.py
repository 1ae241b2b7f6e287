"""Benchmark passages in training texts, by a positional inverted index; DataFrame functions only.

The index holds postings of training tokens: term, document, position, and the words around it. Each
benchmark window is looked up by the term that is rarest in the whole corpus, so its posting list is the
shortest; the lists of the other terms, moved by their offsets, are intersected with it in place, since
a posting carries its neighbourhood. Only lists that some window starts from are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.operators.lookup import fits_broadcast, lookup_join

WINDOW = 10
#: Everything below 128 but digits and a-z, after A-Z were folded.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z folded; none for null."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.array_remove(words, "")


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key that is the same for rows of one id and text, and never null."""
    return docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("_tag"), "text"
    )


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): distinct runs of ``size`` words, or all words of a shorter item, and whose they are."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    # One window per text of an item, however often it is repeated.
    runs = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return runs.groupBy("window").agg(F.collect_set("item").alias("items"))


def anchors_of(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its rarest term and that term's place: (term, offset, window, items).

    Windows with a term that no document has cannot occur and are left out.
    """
    terms = windows.select(F.explode("window").alias("term")).distinct()
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    frequency = tokens.join(F.broadcast(terms) if fits_broadcast(terms) else terms, "term").groupBy("term").count()
    places = windows.select("window", "items", F.posexplode("window").alias("offset", "term"))
    rare = places.join(frequency, "term").groupBy("window").agg(
        F.min(F.struct("count", "term", "offset")).alias("rarest"), F.count(F.lit(1)).alias("known"), F.any_value("items").alias("items")
    )
    return rare.filter(F.col("known") == F.size("window")).select("rarest.term", "rarest.offset", "window", "items")


def postings_of(docs: DataFrame, terms: DataFrame, reach: int = WINDOW) -> DataFrame:
    """Postings of ``terms``: (term, _id, _tag, pos, left, around), ``around`` with up to ``reach - 1`` words on both sides.

    ``docs`` is (_id, _tag, text). A small list of terms is sent to where the texts are read, so that only
    postings of these terms ever leave the reading task; a large one meets the postings in a shuffle.
    """
    split = docs.select("_id", "_tag", words_of(F.col("text")).alias("w"))
    tokens = split.select("_id", "_tag", "w", F.posexplode("w").alias("pos", "term"))
    left = F.least("pos", F.lit(reach - 1))
    around = F.slice("w", F.col("pos") - left + 1, left + reach).alias("around")
    columns = ["term", "_id", "_tag", "pos", left.alias("left"), around]
    if fits_broadcast(terms):
        return tokens.join(F.broadcast(terms), "term").select(*columns)
    return tokens.select(*columns).join(terms, "term")


def _with_windows(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    return postings.join(F.broadcast(anchors) if fits_broadcast(anchors) else anchors, "term")


def phrase_matches(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exact occurrences: (_id, _tag, start, size, items)."""
    at = F.col("left") - F.col("offset") + 1
    size = F.size("window")
    found = _with_windows(postings, anchors).filter((at >= 1) & (F.slice("around", F.greatest(at, F.lit(1)), size) == F.col("window")))
    return found.select("_id", "_tag", (F.col("pos") - F.col("offset")).alias("start"), size.alias("size"), "items")


def proximity_matches(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings of a window's rarest term with all its other terms nearby, in any order: (_id, _tag, pos, items)."""
    found = _with_windows(postings, anchors).filter(F.size(F.array_except("window", "around")) == 0)
    return found.select("_id", "_tag", "pos", "items")


def occurrences(keyed: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """All exact occurrences of the items' windows in (_id, _tag, text); anchors, index and result are written."""
    anchors = written(anchors_of(windows_of(items, size), keyed), "benchmark-anchors")
    index = written(postings_of(keyed, anchors.select("term").distinct(), size), "benchmark-postings")
    return written(phrase_matches(index, anchors), "benchmark-matches")


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item."""
    found = occurrences(_keyed(docs), items, size).select("_id", "_tag").distinct()
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_tag": F.xxhash64(F.col("doc_id").isNull(), "text")})
    return lookup_join(keyed, found, ["_id", "_tag"], "left_anti").select(*docs.columns)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """What of each text is in a benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window: ``size`` words of an item in a row, or the
    whole of a shorter item. Null and empty texts and items have no words. Every row is a document; items
    of one id count as one. n_items and items_sha256 (sorted as strings, joined by commas) tell which
    items have windows that occur.
    """
    keyed, key = _keyed(docs), ["_id", "_tag"]
    found = occurrences(keyed, items, size)
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word")
    hit = found.select(*key, covered).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    which = found.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("ids")
    )
    counted = keyed.select("doc_id", *key, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(hit, key, "left").join(which, key, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
