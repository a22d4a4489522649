"""Near-duplicate documents by SimHash fingerprints and an index of their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.text import row_key
from tidewatch.session import written

#: Words in a shingle, and the most differing bits of linked fingerprints.
SHINGLE, DISTANCE = 3, 3
SEED = 42
#: Sets of four of the eight byte positions whose numbers cancel out: any three positions lie
#: in one of them, and the other four positions form another of the 14. So fingerprints that
#: differ in at most three bytes agree in all four bytes of one set.
POSTINGS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Fingerprints of one posting that are compared in one block; larger postings are cut into parts.
PART = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of the word shingles of one text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)
    tally = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    ones = (tally @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fingerprint) of every row."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(x.as_py(), shingle) for x in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], values], ["doc_id", "key", "fingerprint"])

    rows = documents.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"doc_id {kind}, key long, fingerprint long")


def _spanning(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within one block: one for each fingerprint reached."""
    links: list[tuple[int, int]] = []
    left = prints
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), dtype=bool)
            parent = np.zeros(len(left), dtype=left.dtype)
            for start in range(0, len(frontier), 128):
                some = frontier[start : start + 128]
                differ = some[:, None] ^ left[None, :]
                near = _agreeing(differ) & (np.bitwise_count(differ) <= distance)
                first = near.argmax(axis=0)
                hit = near[first, np.arange(len(left))] & ~reached
                parent[hit] = some[first[hit]]
                reached |= hit
            links += zip(parent[reached].tolist(), left[reached].tolist())
            frontier, left = left[reached], left[~reached]
    return links


def _agreeing(differ: np.ndarray, least: int = 8 - DISTANCE) -> np.ndarray:
    """Count filter: whether at least ``least`` of the eight positional bytes are shared."""
    return sum(((differ >> np.uint64(8 * i)) & np.uint64(255)) == 0 for i in range(8)) >= least


def _links(prints: np.ndarray, groups: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links inside runs of equal ``groups``: all of short runs, connecting ones of long runs."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    links: list[tuple[int, int]] = []
    for start in starts[sizes > 16]:
        links += _spanning(prints[start : start + sizes[np.searchsorted(starts, start)]], distance)
    short = np.repeat(sizes <= 16, sizes)
    for step in range(1, 16):
        at = np.flatnonzero((groups[:-step] == groups[step:]) & short[:-step])
        differ = prints[at] ^ prints[at + step]
        near = at[_agreeing(differ) & (np.bitwise_count(differ) <= distance)]
        links += zip(prints[near].tolist(), prints[near + step].tolist())
    return links


def linked_pairs(prints: DataFrame, distance: int = DISTANCE, part: int = PART) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly those within ``distance`` bits.

    Every fingerprint is posted under 14 keys of four positional bytes. Two that
    differ in at most three bits share at least five of eight bytes, and so one
    key. Under a key the shared bytes of each pair are tallied, pairs with five
    or more are kept, and their bits are compared. A posting above ``part``
    fingerprints is cut into parts, and each two parts meet in a task of their own;
    from a long posting only links that connect its clusters are returned, not all pairs.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the index finds distances up to {DISTANCE}")
    masks = [sum(255 << 8 * i for i in places) for places in POSTINGS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = F.array(*[F.struct(F.lit(i).alias("set"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)])
    postings = prints.select("fingerprint", F.explode(posted).alias("posting")).select("fingerprint", "posting.*")
    large = postings.groupBy("set", "bytes").count().filter(F.col("count") > 2 * part)
    large = large.select("set", "bytes", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    sized = postings.join(written(large, "postings"), ["set", "bytes"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    met = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(
        "fingerprint", F.xxhash64("set", "bytes", F.least("own", "other"), F.greatest("own", "other")).alias("meeting")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame({"fingerprint": [], "meeting": []}, dtype="int64")
        for batch in batches:
            if batch.empty:
                continue
            batch = pd.concat([rest, batch], ignore_index=True)
            meeting = batch["meeting"].to_numpy()
            whole = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on in the next batch
            rest = batch.iloc[whole:]
            if whole:
                yield out(batch.iloc[:whole])
        if len(rest):
            yield out(rest)

    def out(batch: pd.DataFrame) -> pd.DataFrame:
        found = _links(batch["fingerprint"].to_numpy().view(np.uint64), batch["meeting"].to_numpy(), distance)
        return pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    # Meetings are 64-bit hashes: two that collide only compare more pairs.
    ordered = met.repartition("meeting").sortWithinPartitions("meeting", "fingerprint")
    return ordered.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, key, fingerprint (long), component_id, kept_key.

    component_id is the smallest doc_id that links reach, kept_key the ``row_key`` of
    that document (the smallest of them in a tie). Links hold between fingerprints
    that differ in at most ``distance`` bits; texts without words, null among them,
    have fingerprint zero and are linked like any other. A null doc_id is never
    the smallest unless a component has no other. Repeated rows each get their row.
    Other columns are ignored.
    """
    rows = written(fingerprints(documents, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    prints = written(rows.groupBy("fingerprint").agg(first.alias("first")), "fingerprint-groups")
    roots = components(linked_pairs(prints.select("fingerprint"), distance))
    rooted = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = written(rooted.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "fingerprint-roots")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    labels = rooted.select("fingerprint", "root").join(heads, "root")
    labels = written(labels.select("fingerprint", "head.doc_id", "head.key"), "fingerprint-labels")
    labels = labels.withColumnsRenamed({"doc_id": "component_id", "key": "kept_key"})
    return rows.join(labels, "fingerprint").select("doc_id", "key", "fingerprint", "component_id", "kept_key")
