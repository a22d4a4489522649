"""Hash trees over key ranges: digests that say where two tables differ.

A row belongs to the range named by the first hex digits of the md5 of its key, so
ranges are the same in every table and about equally full. A range of the last
level has the number of its rows and the sums of their hashes; a range above
has the digest of its (up to sixteen) children. Trees are small tables that are stored beside
the data. Two tables are compared from the root down: only ranges under a
differing parent are looked at, and only rows of differing last ranges are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import named, quoted
from tidewatch.session import written

#: Hex digits that name a range of the last level: 16^4 ranges.
LEVELS = 4
#: Sums of a leaf, one for every eight hex digits of a row's md5; each stays within BIGINT for 2^31 rows of a range.
SUMS = ("s0", "s1", "s2", "s3")


def row_text(columns: Sequence[str]) -> Column:
    """Values one after the other, each with its length in front, ``-`` for NULL: no two lists of values share a text."""
    parts = []
    for c in columns:
        text = f"CAST({quoted(c)} AS STRING)"
        parts.append(f"coalesce(concat(CAST(length({text}) AS STRING), ':', {text}), '-')")
    return F.expr(f"concat({', '.join(parts)})")


def key_range(keys: Sequence[str], levels: int = LEVELS) -> Column:
    """The range of a row by its key."""
    return F.substring(F.md5(row_text(keys)), 1, levels)


def leaves(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """(range, n_rows, s0..s3) of the ranges that have rows; one scan, sums combine before the shuffle."""
    hashed = df.select(key_range(keys, levels).alias("range"), F.md5(row_text(columns or df.columns)).alias("h"))
    numbers = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint")).alias(s) for i, s in enumerate(SUMS)]
    return hashed.groupBy("range").agg(F.count(F.lit(1)).alias("n_rows"), *numbers)


def merged_leaves(*parts: DataFrame) -> DataFrame:
    """Leaves of tables put together, from their leaves alone: an appended batch never makes the table be read again."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("range").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(s).alias(s) for s in SUMS])


def hash_tree(leaf_rows: DataFrame) -> DataFrame:
    """(level, range, n_rows, digest): the tree over ``leaves``; the root is level 0 with the empty range.

    A group is the sixteen children of a range. An empty table has no rows, so no root.
    The leaves, which are few beside the rows, are written first.
    """
    leaf_rows = written(leaf_rows, "leaves")
    levels = leaf_rows.select(F.max(F.length("range"))).first()[0] or 0
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("n_rows", *SUMS)])
    level = leaf_rows.select(F.lit(levels).alias("level"), "range", "n_rows", F.md5(text).alias("digest"))
    tree = level
    for above in range(levels - 1, -1, -1):
        child = F.struct("range", "digest")
        level = level.groupBy(F.substring("range", 1, above).alias("range")).agg(
            F.sum("n_rows").alias("n_rows"), F.sort_array(F.collect_list(child)).alias("children")
        ).select(
            F.lit(above).alias("level"), "range", "n_rows",
            F.md5(F.array_join(F.transform("children", lambda c: F.concat(c["range"], F.lit("="), c["digest"])), ",")).alias("digest"),
        )
        tree = tree.unionByName(level)
    return tree


def table_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """The hash tree of a table."""
    return hash_tree(leaves(df, keys, columns, levels))


def root_digest(tree: DataFrame) -> DataFrame:
    """(n_rows, digest) of the whole table; no row for an empty one."""
    return tree.filter("level = 0").select("n_rows", "digest")


def walk(left: DataFrame, right: DataFrame) -> DataFrame:
    """(level, range, left_rows, right_rows, differs): the ranges that a descent from the root looks at.

    Each level is met only below ranges of the level above that differ, and is written, as the
    next one starts from it; equal trees end at the root. A level that one tree lacks
    counts as differing. The trees should be stored tables.
    """
    levels = _depth(left, right)
    seen = frontier = None
    for level in range(levels + 1):
        sides = []
        for tree, side in ((left, "left"), (right, "right")):
            nodes = tree.filter(F.col("level") == level).select("range", F.col("n_rows").alias(f"{side}_rows"), F.col("digest").alias(f"{side}_digest"))
            if frontier is not None:
                nodes = nodes.withColumn("_above", F.substring("range", 1, level - 1)).join(frontier, "_above", "left_semi").drop("_above")
            sides.append(nodes)
        met = sides[0].join(sides[1], "range", "full_outer").select(
            F.lit(level).alias("level"), "range", *[F.coalesce(f"{s}_rows", F.lit(0)).alias(f"{s}_rows") for s in ("left", "right")],
            (~F.col("left_digest").eqNullSafe(F.col("right_digest"))).alias("differs"),
        )
        met = written(met, "walk")
        frontier = met.filter("differs").select(F.col("range").alias("_above"))
        seen = met if seen is None else seen.unionByName(met)
        if frontier.isEmpty():
            break
    return seen


def _depth(*trees: DataFrame) -> int:
    return max(t.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for t in trees)


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(range, left_rows, right_rows): ranges of the last level whose rows differ."""
    levels = _depth(left, right)
    return walk(left, right).filter((F.col("level") == levels) & F.col("differs")).drop("level", "differs")


def differing_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
    left_tree: DataFrame | None = None, right_tree: DataFrame | None = None, levels: int = LEVELS,
) -> DataFrame:
    """(keys, kind, left_rows, right_rows) of every key whose rows differ: ``missing`` on the right, ``extra`` on the right or ``changed``.

    Stored trees spare the aggregation; tables are then read once each, and only rows of
    differing ranges are shuffled. Rows of one key are compared as a multiset, so copies
    count. NULL is a key like any other.
    """
    columns = list(columns or left.columns)
    left_tree = written(table_tree(left, keys, columns, levels), "tree") if left_tree is None else left_tree
    right_tree = written(table_tree(right, keys, columns, levels), "tree") if right_tree is None else right_tree
    ranges = differing_ranges(left_tree, right_tree).select("range")

    def signed(df: DataFrame, left: int, right: int) -> DataFrame:
        rows = df.withColumn("_range", key_range(keys, levels)).join(ranges.withColumnRenamed("range", "_range"), "_range", "left_semi")
        hashed = rows.select(*[named(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.md5(row_text(columns)).alias("_h"))
        halves = hashed.withColumns({"_low": F.xxhash64("_h"), "_high": F.xxhash64(F.lit("high"), "_h")}).drop("_h")
        parts = [p for h in ("_low", "_high") for p in (F.col(h).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
        return halves.select(
            *[f"_k{i}" for i in range(len(keys))], F.lit(left).cast("bigint").alias("left_rows"), F.lit(right).cast("bigint").alias("right_rows"),
            *[(p * F.lit(left - right)).alias(s) for p, s in zip(parts, SUMS)],
        )

    # Both tables meet in one aggregation, in which rows of a key add up before the shuffle. Hashes of the right table count
    # against those of the left one: where the rows of a key are the same, the sums are 0.
    both = signed(left, 1, 0).unionAll(signed(right, 0, 1)).groupBy(*[f"_k{i}" for i in range(len(keys))])
    sums = both.agg(*[F.sum(s).alias(s) for s in ("left_rows", "right_rows", *SUMS)])
    differ = sums.filter((F.col("left_rows") != F.col("right_rows")) | F.greatest(*[F.abs(s) for s in SUMS]).cast("boolean"))
    kind = F.when(F.col("right_rows") == 0, "missing").when(F.col("left_rows") == 0, "extra").otherwise("changed")
    return differ.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], kind.alias("kind"), "left_rows", "right_rows")
