"""Filters of stored hashes: arriving records that are certainly new never meet the store.

A filter is a table of blocks of 32 768 bits. A hash sets ``PROBES`` bits of one block, which is
chosen by the hash as well, so a membership test is one join on the block's number. Filters are
built per batch, are a fraction of the hashes' size, and merge by OR. A hash whose bits are not all
set has never been stored; the others are looked up among the hashes of the batches whose own filters
have them, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import named
from tidewatch.session import written

#: Bits of a block, and bits that a hash sets in it.
BLOCK_BITS, PROBES = 1 << 15, 6
#: Blocks of a filter: 2^12 blocks are 16 MB when all are used, good for some ten million hashes at a false share below 1 %.
BLOCKS = 1 << 12
#: Slices of a block in ``build_slices``, their bits, and bits that a key sets in one.
SLICES, SLICE_BITS, SLICE_PROBES = 1 << 5, 1 << 10, 3
#: Column of ``maybe_among``.
MAYBE = "_maybe"


def _mixed(column: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), column)


def _block(column: Column, blocks: int) -> Column:
    return F.pmod(_mixed(column, -1), F.lit(blocks)).cast("int")


def _places(column: Column) -> Column:
    """The bits of a hash inside its block: stretches of 15 bits, three from each of two numbers."""
    return F.array(*[F.shiftrightunsigned(_mixed(column, i // 3), 15 * (i % 3)).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(PROBES)])


def build_filter(hashes: DataFrame, column: str = "record_hash", by: tuple[str, ...] = (), blocks: int = BLOCKS) -> DataFrame:
    """(by, block, bits): the filter of a column, per batch if ``by`` names one. NULL is in no filter.

    Bits are set before the shuffle, in which a task sends 4 KB per block that it has seen.
    """
    rows = hashes.filter(named(column).isNotNull()).select(*[named(b) for b in by], _block(named(column), blocks).alias("block"), F.explode(_places(named(column))).alias("place"))
    return rows.groupBy(*[named(b) for b in by], "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def merge_filters(filters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Filters put together by OR; those must have the same number of blocks."""
    return filters.groupBy(*[named(b) for b in by], "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(place: Column, bits: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(7)).bitwiseAND(1) == 1


def _all_set(places: Column, bits: Column) -> Column:
    return F.forall(places, lambda place: _is_set(place, bits))


def maybe_stored(hashes: DataFrame, filters: DataFrame, column: str = "record_hash", blocks: int = BLOCKS) -> DataFrame:
    """The distinct hashes that may be stored, with further columns of ``filters`` such as the batch; all others are certainly not.

    Copies meet before the shuffle. The filter is broadcast by Spark only while it is small.
    """
    single = hashes.filter(named(column).isNotNull()).select(named(column).alias("_hash")).distinct()
    probed = single.select("_hash", _block(F.col("_hash"), blocks).alias("block"), _places(F.col("_hash")).alias("_places"))
    met = probed.join(filters, "block").filter(_all_set(F.col("_places"), F.col("bits")))
    return met.drop("block", "_places", "bits").withColumnRenamed("_hash", column)


def _slice(column: Column) -> Column:
    return F.pmod(_mixed(column, -2), F.lit(BLOCKS * SLICES)).cast("int")


def _slice_places(column: Column) -> list[Column]:
    return [F.shiftrightunsigned(_mixed(column, -3), 16 * i).bitwiseAND(SLICE_BITS - 1).cast("int") for i in range(SLICE_PROBES)]


def build_slices(keys: DataFrame, column: str) -> DataFrame:
    """(slice, bits): a filter of a column in slices of 128 bytes, 16 MB at most, so that a row that is tested against a broadcast of it carries little."""
    found = keys.filter(named(column).isNotNull()).select(_slice(named(column)).alias("slice"), F.explode(F.array(*_slice_places(named(column)))).alias("place"))
    place = F.col("slice") % SLICES * SLICE_BITS + F.col("place")
    blocks = found.groupBy(F.expr(f"CAST(slice DIV {SLICES} AS INT)").alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring("bits", i * (SLICE_BITS // 8) + 1, F.lit(SLICE_BITS // 8)))
    return blocks.select("block", F.posexplode(parts).alias("at", "bits")).select((F.col("block") * SLICES + F.col("at")).alias("slice"), "bits")


def maybe_among(rows: DataFrame, slices: DataFrame, column: str) -> DataFrame:
    """All rows with ``MAYBE``: false where the column's value is certainly not among the keys of ``build_slices``, which are broadcast."""
    slices = slices.select(F.col("slice").alias("_slice"), F.col("bits").alias("_bits"))
    met = rows.withColumn("_slice", _slice(named(column))).join(F.broadcast(slices), "_slice", "left")
    maybe = F.col("_bits").isNotNull()
    for place in _slice_places(named(column)):
        maybe = maybe & _is_set(place, F.col("_bits"))
    return met.withColumn(MAYBE, maybe).drop("_slice", "_bits")


def known_hashes(incoming: DataFrame, filters: DataFrame, batch: str, read_batches, column: str = "record_hash", blocks: int = BLOCKS) -> DataFrame:
    """The arriving hashes that are stored, exactly.

    ``filters`` has a filter per ``batch``; ``read_batches(names)`` reads the stored hashes of some
    batches. Arriving hashes are tested against the merged filter first; what is left, against
    each batch's; and only batches that may have one of them are read, joined with those few hashes. Only names
    of batches come to the driver.
    """
    suspects = written(maybe_stored(incoming, merge_filters(filters), column, blocks).select(named(column)), "suspects")
    by_batch = maybe_stored(suspects, filters, column, blocks)
    names = sorted(r[0] for r in by_batch.select(named(batch)).distinct().collect())
    stored = read_batches(names).select(named(column)).distinct()
    return stored.join(suspects, column, "left_semi")
