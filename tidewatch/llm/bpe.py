"""Byte-pair encoding and decoding through a distinct-word table."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidewatch.llm.text import row_key

#: Python's split() also cuts at these separators, which tokenizers do not take for white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"(?:(?![\x1c-\x1f])\s)+")
#: Documents decoded at a time.
_ROWS = 256


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    """Once per Python worker."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str]:
    """The id-to-piece table, by id."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        pieces[at] = piece
    return pieces


def split_words(text: str) -> list[str]:
    """The runs of characters between white space, none of which a token can cross."""
    if not _SEPARATORS.search(text):
        return text.split()
    return [w for w in _SPACES.split(text) if w]


def _by_bucket(texts: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """The distinct words of a block, sorted, in buckets that are the same for every block."""
    distinct: set[str] = set()
    for text in texts:
        distinct.update(split_words(text))
    found: dict[int, list[str]] = defaultdict(list)
    for word in distinct:
        found[zlib.crc32(word.encode()) % buckets].append(word)
    for words in found.values():
        words.sort()
    return found


def encode(documents: DataFrame, path: str, blocks: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, key, n_tokens, ids; with ``with_text`` also decoded, as ``decode`` gives it.

    ids are little-endian unsigned 32-bit integers; they equal what the tokenizer
    in ``path`` gives for the whole text without special tokens of its own.
    Null texts count as empty and have no ids. Repeated rows each get their row;
    other columns are ignored.

    The tokenizer must not join tokens across white space.
    Documents are dealt over ``blocks`` (by default twice the input partitions). A
    block sends its distinct words, sorted and cut into hash buckets, to the bucket's
    task, which encodes each distinct word of the corpus once. The ids come back in
    the order of the block's words and are joined to every position of a word. A
    frequent word is one entry per block, so no bucket is hot, and no table of words
    is broadcast.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = blocks or max(1, 2 * rows.rdd.getNumPartitions())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([packer.compress((x.as_py() or "").encode()) for x in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["block"], batch["doc_id"], batch["key"], packed], ["block", "doc_id", "key", "packed"])

    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).mapInArrow(
        pack, f"block int, doc_id {kind}, key long, packed binary"
    ).repartition(blocks, "block")

    def unpacked(table: pa.Table) -> Iterator[str]:
        """One text after the other, so that a block is never unpacked as a whole."""
        opener = zstandard.ZstdDecompressor()
        return (opener.decompress(x.as_py()).decode() for x in table["packed"])

    def parcels(table: pa.Table) -> pa.Table:
        packer = zstandard.ZstdCompressor(level=3)
        found = _by_bucket(unpacked(table), blocks)
        block = table["block"][0].as_py() if len(table) else 0
        packed = [packer.compress("\n".join(w).encode()) for w in found.values()]
        columns = [pa.array(list(found), pa.int32()), pa.array([block] * len(found), pa.int32()), pa.array(packed, pa.binary())]
        return pa.Table.from_arrays(columns, ["bucket", "block", "packed"])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known: dict[str, bytes] = {}
        current = None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch["bucket"], batch["packed"]):
                if bucket != current:  # a bucket's words stand in no other
                    current, known = bucket, {}
                words = opener.decompress(packed).decode().split("\n")
                new = [w for w in words if w not in known]
                for word, code in zip(new, _tokenizer(path).encode_batch(new, add_special_tokens=False)):
                    known[word] = np.array(code.ids, dtype="<u4").tobytes()
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), dtype="<u4", count=len(ids))
                out.append(packer.compress(sizes.tobytes() + b"".join(ids)))
            yield pd.DataFrame({"block": batch["block"], "bucket": batch["bucket"], "codes": out})

    def join(texts: pa.Table, codes: pa.Table) -> pa.Table:
        opener, words, of = zstandard.ZstdDecompressor(), _by_bucket(unpacked(texts), blocks), {}
        for bucket, packed in zip(codes["bucket"].to_pylist(), codes["codes"]):
            here, all_ids = words.pop(bucket), opener.decompress(packed.as_py())
            ends, start = np.cumsum(np.frombuffer(all_ids, dtype="<u4", count=len(here))) + 4 * len(here), 4 * len(here)
            for word, end in zip(here, ends.tolist()):
                of[word] = all_ids[start:end]
                start = end
        del words
        all_texts, columns = unpacked(texts), ([], [], [])
        while some := [b"".join(map(of.__getitem__, split_words(x))) for x in islice(all_texts, _ROWS)]:
            columns[0].append(pa.array([len(x) // 4 for x in some], pa.int64()))
            columns[1].append(pa.array(some, pa.binary()))
            columns[2].append(_spelled(some, path) if with_text else pa.nulls(len(some), pa.string()))
        kinds = (pa.int64(), pa.binary(), pa.string())[: 2 + with_text]
        made = [pa.chunked_array(c, k) for c, k in zip(columns, kinds)]
        return pa.Table.from_arrays([texts["doc_id"], texts["key"], *made], ["doc_id", "key", "n_tokens", "ids", "decoded"][: 4 + with_text])

    sent = dealt.groupBy("block").applyInArrow(parcels, "bucket int, block int, packed binary")
    back = sent.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(encoded, "block int, bucket int, codes binary")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        join, f"doc_id {kind}, key long, n_tokens long, ids binary" + ", decoded string" * with_text
    )


def _spelled(ids: list[bytes], path: str) -> pa.Array:
    """The pieces of each text's ids, joined by spaces."""
    pieces = _pieces(path)
    return pa.array([" ".join(map(pieces.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in ids], pa.string())


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (doc_id, key, n_tokens, ids) with decoded: the pieces of its ids, as the tokenizer decodes them with special tokens.

    Every id is joined with its piece by position; the table of pieces is as long as the
    vocabulary. The tokenizer must have no decoder: then pieces are joined by spaces.
    """
    fields = ["doc_id", "key", "n_tokens", "ids"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _ROWS):
                some = batch.slice(start, _ROWS)
                yield pa.RecordBatch.from_arrays([*(some[f] for f in fields), _spelled(some["ids"].to_pylist(), path)], [*fields, "decoded"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select(fields).mapInArrow(spell, f"doc_id {kind}, key long, n_tokens long, ids binary, decoded string")
