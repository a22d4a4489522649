"""Labelled training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(rank, text, label): at most ``most`` labelled rows that are not held out, chosen by a hash of their id.

    This bounded sample is all a model is fitted on. Rows without a label, and
    ids that carry both labels, are left out.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("high")).filter("label = high")
    rank = F.xxhash64("doc_id", F.lit(label)).alias("rank")
    chosen = marked.select("doc_id", "label", rank).orderBy("rank", "doc_id").limit(most)
    # At most ``most`` ids and labels.
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("rank", "text", F.col("label").cast("int").alias("label"))
