"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.text import BROADCAST_TEXT_BYTES, alnum_words, bound, count_alnum_words, if_small, row_key

#: Consecutive words that count as leaked, and the words in a fingerprint. A window of
#: SPAN - GRAM + 1 grams keeps its smallest hash, so every shared run of SPAN words shares a fingerprint.
SPAN, GRAM = 10, 5


def gram_hashes(words: Column, size: int) -> Column:
    """A hash of each ``size`` consecutive words."""
    def grams(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - F.lit(size - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, size)]))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), grams)


def winnowed(words: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """Gram hashes at their word positions; null where a gram is not the minimum of any window.

    A gram is kept if a window that contains it has no smaller hash, which is so
    if the largest of these windows' minima is the gram's own hash. Ties are all kept.
    """
    wide = span - gram + 1

    def kept(g: Column) -> Column:
        def choose(minima: Column) -> Column:
            return F.transform(g, lambda x, i: F.when(x == F.greatest(*[F.get(minima, i - j) for j in range(wide)]), x))

        starts = F.slice(g, F.lit(1), F.greatest(F.size(g) - F.lit(wide - 1), F.lit(0)))
        minima = F.transform(starts, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, wide)]))
        return bound(minima, choose)

    return bound(gram_hashes(words, gram), kept)


def _fingerprints(rows: DataFrame, key: str, words: str, span: int, gram: int, short: list[int]) -> DataFrame:
    """(key, size, at, print): winnowed grams, and all grams of the lengths of short items."""
    kinds = [(0, winnowed(F.col(words), span, gram)), *[(m, gram_hashes(F.col(words), m)) for m in short]]
    parts = [
        rows.select(key, F.lit(size).alias("size"), F.posexplode(prints).alias("at", "print")).filter(F.col("print").isNotNull())
        for size, prints in kinds
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaked_windows(
    documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_TEXT_BYTES
) -> DataFrame:
    """(key, item_id, first, last): where windows of benchmark items stand in documents, in word positions.

    ``documents`` has key and text, ``benchmark`` has item_id and text. A window is
    ``span`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Fingerprints of both sides are joined; each fingerprint of a document that an item
    has as well is extended to the windows that contain it, and these are held against the items' windows by 128
    bits of their words. A place is extended once, however many items and places of items it
    meets, so texts and items of repeated words give no more rows than they have windows.

    The fingerprints of the benchmark are broadcast while its texts are below ``broadcast_bytes``, and
    joined by shuffle beyond it; nothing else is broadcast by force.
    """
    small = if_small(benchmark, "text", broadcast_bytes)
    side = F.broadcast if small else (lambda df: df)
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    # At most span - 1 lengths.
    short = sorted(r[0] for r in items.filter(F.size("words") < span).select(F.size("words")).distinct().collect())
    prints = items.filter(F.size("words") >= span).select(F.lit(0).alias("size"), F.explode(winnowed(F.col("words"), span, gram)).alias("print"))
    for m in short:
        whole = items.filter(F.size("words") == m).select(F.lit(m).alias("size"), gram_hashes(F.col("words"), m)[0].alias("print"))
        prints = prints.unionByName(whole)
    prints = prints.filter("print IS NOT NULL").distinct()

    texts = documents.select("key", alnum_words(F.col("text")).alias("words"))
    found = _fingerprints(texts, "key", "words", span, gram, short)
    places = found.join(side(prints), ["size", "print"], "left_semi").select("key", "size", "at").distinct()
    # One row per document that has a match, with the places in it, which are no more than its words, meets the text again.
    per_document = places.groupBy("key").agg(F.collect_list(F.struct("size", "at")).alias("places"))
    texts = documents.select("key", "text").join(per_document, "key")
    texts = texts.dropDuplicates(["key"]).select("key", "places", alnum_words(F.col("text")).alias("words"))

    def around(words: Column) -> Column:
        """The distinct windows that contain a place."""
        def starts(place: Column) -> Column:
            first, last = F.greatest(place["at"] - (span - gram), F.lit(0)), F.least(place["at"], F.size(words) - span)
            long = F.when(F.size(words) >= span, F.transform(F.sequence(first, last), lambda i: _window(i, F.lit(span))))
            return F.when(place["size"] > 0, F.array(_window(place["at"], place["size"]))).otherwise(F.coalesce(long, F.array().cast(kind)))

        distinct = F.array_distinct(F.flatten(F.transform("places", starts)))
        return F.transform(distinct, lambda w: F.struct(w["first"].alias("first"), w["wide"].alias("wide"), _identity(words, w["first"], w["wide"]).alias("same")))

    kind = "array<struct<first:int,wide:int>>"
    windows = texts.select("key", F.explode(bound(F.col("words"), around)).alias("window")).select("key", "window.*")
    wide = F.least(F.size("words"), F.lit(span))
    of_items = items.select("item_id", wide.alias("wide"), F.explode(bound(F.col("words"), lambda words: F.transform(
        F.sequence(F.lit(0), F.size(words) - F.least(F.size(words), F.lit(span))), lambda i: _identity(words, i, F.least(F.size(words), F.lit(span)))
    ))).alias("same")).distinct()
    met = windows.join(of_items, ["wide", "same"])
    return met.select("key", "item_id", "first", (F.col("first") + F.col("wide") - 1).alias("last"))


def _window(first: Column, wide: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), wide.cast("int").alias("wide"))


def _identity(words: Column, first: Column, wide: Column) -> Column:
    """128 bits of ``wide`` words; words hold no space."""
    return F.md5(F.array_join(F.slice(words, first + 1, wide), " "))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_words, n_hit, n_items, item_ids, contaminated.

    n_hit counts words inside any occurrence of a window of an item; item_ids are
    the items with an occurring window, as sorted strings. Null or empty texts
    have no words and no hits. Null item_ids hit but are not listed. Repeated
    documents each get their row; an empty benchmark hits nothing. Other columns
    are ignored. ``options`` go to ``leaked_windows``.
    """
    rows = documents.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    windows = leaked_windows(rows.select("key", "text"), benchmark, **options)
    # Words of a document's windows, each counted where no earlier window covers it.
    before = Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("last") - F.greatest(F.coalesce(F.max("last").over(before), F.col("first") - 1), F.col("first") - 1)
    hits = windows.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("key").agg(
        F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    counted = rows.select("doc_id", "key", count_alnum_words(F.col("text")).alias("n_words")).join(hits, "key", "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return counted.select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
