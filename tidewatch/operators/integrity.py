"""Primary and foreign keys: counts, samples and the offending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewatch.functions.results import error_list, result_rows, result_struct
from tidewatch.functions.scalars import named, safe_rate
from tidewatch.functions.skew import join_per_key

SAMPLES = 100


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "occurrence_count") -> DataFrame:
    """Rows per key value; NULL keys form one group."""
    return df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def duplicate_keys(df: DataFrame, keys: Sequence[str], limit: int | None = SAMPLES) -> DataFrame:
    """Keys that occur more than once, smallest first; all of them without ``limit``."""
    found = key_counts(df, keys).filter(F.col("occurrence_count") > 1)
    return found if limit is None else found.orderBy(*[named(k) for k in keys]).limit(limit)


def _first_keys(found: DataFrame, keys: Sequence[str], limit: int = SAMPLES) -> Column:
    """The smallest ``limit`` keys as texts, in order: a scalar that a result row carries along."""
    top = found.orderBy(*[named(k).asc_nulls_first() for k in keys]).limit(limit)
    text = F.concat_ws(", ", *[F.coalesce(named(k).cast("string"), F.lit("NULL")) for k in keys])
    ordered = F.sort_array(F.collect_list(F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)], text.alias("text"))))
    return top.agg(ordered["text"].alias("sample")).scalar()


def pk_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, the number of duplicated keys, and the first of them as texts."""
    many = F.col("occurrence_count") > 1
    return (
        key_counts(df, keys)
        .agg(
            F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("total_records"),
            F.coalesce(F.sum(F.when(many, F.col("occurrence_count") - 1)), F.lit(0)).alias("duplicate_count"),
            F.count_if(many).alias("unique_duplicate_keys"),
        )
        .withColumn("has_duplicates", F.col("unique_duplicate_keys") > 0)
        .withColumn("sample_keys", _first_keys(duplicate_keys(df, keys, None), keys))
    )


def detect_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, distinct and difference for the given keys, and the first repeated keys; no keys means no duplicates."""
    sample = _first_keys(duplicate_keys(df, keys, None), keys) if keys else F.array().cast("array<string>")
    if not keys:
        totals = df.agg(F.count(F.lit(1)).alias("total_records")).withColumn(
            "unique_records", F.col("total_records")
        )
    else:
        totals = key_counts(df, keys).agg(
            F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("total_records"),
            F.count(F.lit(1)).alias("unique_records"),
        )
    return (
        totals.withColumn("duplicate_count", F.col("total_records") - F.col("unique_records"))
        .withColumn("has_duplicates", F.col("duplicate_count") > 0)
        .withColumn("sample_keys", sample)
    )


def dup_pk_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once; rows with a NULL key part are left out."""
    counts = duplicate_keys(df, keys, None).withColumnRenamed("occurrence_count", "_pk_occurrence_count")
    rows = join_per_key(df, counts, list(keys), "_pk_occurrence_count")
    return rows.select(*[named(c) for c in df.columns], "_pk_occurrence_count")


def _spread(child: DataFrame, value: Column) -> Column:
    """A second join key of child rows, 0 but where ``value`` is NULL: such rows find no parent anywhere, so their own hash deals them over all tasks."""
    # Maps have no hash.
    columns = [named(f.name) for f in child.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.when(value.isNull(), F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _zero(parent: Column) -> Column:
    """0 for every parent key: the other side of ``_spread``, which the optimizer must not take for a constant, as a constant is no join key."""
    return F.pmod(F.xxhash64(parent), F.lit(1).cast("bigint"))


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent, in one scan; a NULL foreign key has none.

    The anti join keeps NULL keys, whose rows are dealt over all tasks. Both sides come straight from a shuffle, so AQE
    splits the partition in which another hot key meets.
    """
    parents = parent.select(named(key).alias("_parent"), _zero(named(key)).alias("_zero"))
    return child.join(parents, (named(fk) == F.col("_parent")) & (_spread(child, named(fk)) == F.col("_zero")), "left_anti")


def _orphan_counts(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """(value, n) per orphaned key value; hot keys are counted before the shuffle."""
    values = child.groupBy(named(fk).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(named(key).alias("_parent"))
    return values.join(parents, F.col("value") == F.col("_parent"), "left_anti")


def fk_orphan_values(
    child: DataFrame, fk: str, parent: DataFrame, key: str, limit: int = SAMPLES
) -> DataFrame:
    """Distinct orphaned values, smallest first (NULL included)."""
    return (
        _orphan_counts(child, fk, parent, key)
        .select(F.col("value").alias(fk)).orderBy(F.col(fk).asc_nulls_first()).limit(limit)
    )


def _common_type(spark, a: T.DataType, b: T.DataType) -> str:
    """The type in which a foreign key and its parent key are compared; a text is read as the other's type."""
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        other = b if isinstance(a, T.StringType) else a
        return other.simpleString()
    both = f"coalesce(CAST(NULL AS {a.simpleString()}), CAST(NULL AS {b.simpleString()}))"
    return spark.range(0).select(F.expr(both).alias("c")).schema[0].dataType.simpleString()


def _match_text(column: Column, kind: str) -> Column:
    """Equal values of a type have equal texts."""
    value = column.try_cast(kind)
    return (value + F.lit(0.0) if kind in ("float", "double") else value).cast("string")


def _match_value(column: Column, kind: str) -> Column:
    """Equal where ``_match_text`` is, and shorter: numbers and times stay what they are."""
    if kind.startswith(("decimal", "timestamp")) or kind in ("tinyint", "smallint", "int", "bigint", "date", "boolean"):
        return column.try_cast(kind)
    return column.try_cast(kind) + F.lit(0.0).cast(kind) if kind in ("float", "double") else _match_text(column, kind)


def _key_problem(child: DataFrame, fk: str, parent_name: str, key: str, parents: Mapping[str, DataFrame]) -> str | None:
    if fk not in child.columns:
        return f"Foreign key column '{fk}' not found in dataset"
    if parents.get(parent_name) is None:
        return f"Parent dataset '{parent_name}' not provided"
    if key not in parents[parent_name].columns:
        return f"Parent key column '{key}' not found in parent dataset"
    return None


def _tagged(
    child: DataFrame, foreign_keys: Mapping[str, tuple[str, str]], parents: Mapping[str, DataFrame]
) -> tuple[Column, DataFrame, list[str]]:
    """For all usable foreign keys together: an array of (key, own, value) of a child row, the union of (key, value) of all parents, and the names.

    ``key`` is a number of the list of names. A row's entries are made in one pass,
    however many keys there are, and all of them meet all parents in one join.
    """
    usable = [fk for fk, (parent, key) in foreign_keys.items() if _key_problem(child, fk, parent, key, parents) is None]
    entries, sides = [], []
    for at, fk in enumerate(usable):
        parent, key = parents[foreign_keys[fk][0]], foreign_keys[fk][1]
        kind = _common_type(child.sparkSession, child.schema[fk].dataType, parent.schema[key].dataType)
        entries.append(
            F.struct(F.lit(at).alias("key"), named(fk).cast("string").alias("own"), _match_text(named(fk), kind).alias("value"))
        )
        sides.append(parent.select(F.lit(at).alias("key"), _match_text(named(key), kind).alias("value")).filter("value IS NOT NULL"))
    return F.array(*entries), reduce(DataFrame.unionAll, sides) if sides else None, usable


def _orphans_of_all(child: DataFrame, foreign_keys: Mapping[str, tuple[str, str]], parents: Mapping[str, DataFrame]) -> tuple[DataFrame | None, list[str]]:
    """(key, own, n): orphaned values of every foreign key with their rows, from one scan of the child table.

    Values are counted before the shuffle, so a hot value is one row per task.
    """
    entries, keys, usable = _tagged(child, foreign_keys, parents)
    if not usable:
        return None, usable
    values = child.select(F.inline(entries)).groupBy("key", "own", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.join(keys, ["key", "value"], "left_anti").select("key", "own", "n"), usable


def fk_check(
    child: DataFrame,
    foreign_keys: Mapping[str, tuple[str, str]],
    parents: Mapping[str, DataFrame],
) -> DataFrame:
    """One row per foreign key, with the first orphaned values; a missing column or parent is an error entry with no orphans.

    The child table is read once for all keys: its rows are turned to (key, value),
    counted, and joined once with the union of the parents' keys.
    """
    spark = child.sparkSession
    orphans, usable = _orphans_of_all(child, foreign_keys, parents)
    declared = [
        (i, fk, parent, key, usable.index(fk) if fk in usable else -1 - i, _key_problem(child, fk, parent, key, parents))
        for i, (fk, (parent, key)) in enumerate(foreign_keys.items())
    ]
    rows = spark.createDataFrame(
        declared, "position int, fk_column string, parent_dataset string, parent_key_column string, key int, error string"
    )
    if orphans is None:
        orphans = spark.createDataFrame([], "key int, own string, n bigint")
    counted = orphans.groupBy("key").agg(F.sum("n").alias("orphan_count"), F.count(F.lit(1)).alias("orphan_keys"))
    # Numbers in their order, then texts; the limit per key is taken before the shuffle. The count goes along, so
    # that this branch and the one above ask for the same shuffle, which Spark then does once.
    numeric = [i for i, fk in enumerate(usable) if isinstance(child.schema[fk].dataType, T.NumericType)]
    is_number = F.col("key").isin(numeric) if numeric else F.lit(False)
    number, size = (F.when(is_number, F.col("own").try_cast(kind)) for kind in ("decimal(38,18)", "double"))
    place = F.struct(number.alias("number"), size.alias("size"), "own", "n")
    order = Window.partitionBy("key").orderBy(F.col("place").asc_nulls_first())
    first = orphans.select("key", place.alias("place")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLES)
    listed = first.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places")).select(
        "key", F.transform("places", lambda p: F.coalesce(p["own"], F.lit("NULL"))).alias("sample_orphans")
    )
    zero = F.lit(0).cast("bigint")
    joined = rows.join(counted, "key", "left").join(listed, "key", "left")
    return joined.select(
        "fk_column", "parent_dataset", "parent_key_column",
        (F.col("error").isNull() & F.col("orphan_count").isNull()).alias("valid"),
        F.coalesce("orphan_count", zero).alias("orphan_count"),
        F.coalesce("orphan_keys", zero).alias("orphan_keys"),
        F.coalesce("sample_orphans", F.array().cast("array<string>")).alias("sample_orphans"),
        "error",
    )


def integrity_check(
    df: DataFrame,
    primary_key: Sequence[str] = (),
    foreign_keys: Mapping[str, tuple[str, str]] | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    name: str = "ReferentialIntegrityValidator",
) -> DataFrame:
    """Failed when any key is duplicated or orphaned; failed records are added up."""
    parts = []
    if primary_key:
        text = f" duplicate primary key value(s) in columns: {', '.join(primary_key)}"
        parts.append(
            pk_uniqueness(df, primary_key).select(
                F.lit(0).alias("position"), "total_records",
                F.col("duplicate_count").alias("failed"), F.lit(text).alias("text"),
            )
        )
    else:
        parts.append(
            df.agg(F.count(F.lit(1)).alias("total_records")).select(
                F.lit(0).alias("position"), "total_records",
                F.lit(0).cast("bigint").alias("failed"), F.lit("").alias("text"),
            )
        )
    if foreign_keys and parents:
        text = F.concat(F.lit(" orphan record(s) with invalid foreign key '"), "fk_column", F.lit("'"))
        parts.append(
            fk_check(df, foreign_keys, parents).select(
                F.lit(1).alias("position"), F.lit(0).cast("bigint").alias("total_records"),
                F.col("orphan_count").alias("failed"), text.alias("text"),
            )
        )
    problem = F.when(
        F.col("failed") > 0,
        F.struct("position", F.concat(F.lit("Found "), F.col("failed").cast("string"), "text").alias("text")),
    )
    measured = reduce(DataFrame.unionAll, parts).agg(
        F.max("total_records").alias("total"),
        F.sum("failed").alias("failed"),
        # One entry per declared key, so the list is as short as the configuration.
        F.sort_array(F.collect_list(problem)).alias("problems"),
    )
    total, failed, errors = F.col("total"), F.col("failed"), F.col("problems.text")
    issues = F.size(errors)
    status = F.when(issues > 0, "failed").otherwise("passed")
    message = F.when(
        issues > 0,
        F.concat(
            F.lit("Referential integrity validation failed with "), issues.cast("string"), F.lit(" issue(s)")
        ),
    ).otherwise("All referential integrity checks passed")
    rate = safe_rate(total - failed, total, 100.0)
    return result_rows(
        measured,
        result_struct(name, status, total, failed, message, F.coalesce(errors, error_list()), rate=rate),
    )


def union_orphans(
    child: DataFrame,
    foreign_keys: Mapping[str, tuple[str, str]],
    parents: Mapping[str, DataFrame],
) -> DataFrame:
    """Orphans of every usable foreign key, tagged with the key column, from one scan of the child table.

    A row meets one parent after the other and is repeated only at the end, once per key without a parent. It
    is shuffled for large parents alone, as it is; small ones are broadcast. Rows with a NULL are dealt over all
    tasks, and AQE splits another hot value: parent keys, made distinct, are shuffled again for the two join keys.
    """
    usable = [fk for fk, (parent, key) in foreign_keys.items() if _key_problem(child, fk, parent, key, parents) is None]
    if not usable:
        return child.limit(0).withColumn("_invalid_fk_column", F.lit(""))
    rows, missing = child, []
    for at, fk in enumerate(usable):
        parent, key = parents[foreign_keys[fk][0]], foreign_keys[fk][1]
        kind = _common_type(child.sparkSession, child.schema[fk].dataType, parent.schema[key].dataType)
        value, hit = _match_value(named(fk), kind), f"_hit{at}"
        keys = parent.select(_match_value(named(key), kind).alias("_parent")).filter("_parent IS NOT NULL").distinct()
        keys = keys.select(F.col("_parent").alias(f"_parent{at}"), _zero(F.col("_parent")).alias(f"_zero{at}"), F.lit(True).alias(hit))
        met = (value == F.col(f"_parent{at}")) & (_spread(child, value) == F.col(f"_zero{at}"))
        rows = rows.join(keys, met, "left").drop(f"_parent{at}", f"_zero{at}")
        missing.append(F.when(F.col(hit).isNull(), F.lit(fk)))
    found = rows.filter(reduce(lambda a, b: a | b, [m.isNotNull() for m in missing]))
    return found.select(*[named(c) for c in child.columns], F.explode(F.array_compact(F.array(*missing))).alias("_invalid_fk_column"))


def union_failed_rows(
    df: DataFrame,
    primary_key: Sequence[str] = (),
    foreign_keys: Mapping[str, tuple[str, str]] | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    validation_type: str = "all",
) -> DataFrame:
    """Duplicate-key rows and orphans in one frame, tagged with the kind of failure."""
    frames = []
    if validation_type in ("primary_key", "all") and primary_key:
        frames.append(
            dup_pk_rows(df, primary_key).withColumn(
                "validation_failure_type", F.lit("duplicate_primary_key")
            )
        )
    if validation_type in ("foreign_key", "all") and foreign_keys and parents:
        frames.append(
            union_orphans(df, foreign_keys, parents).withColumn(
                "validation_failure_type", F.lit("orphan_foreign_key")
            )
        )
    if not frames:
        return df.limit(0).withColumn("validation_failure_type", F.lit(""))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rows_not_matching(df: DataFrame, column: str, expected=True) -> DataFrame:
    """Rows whose value differs from ``expected``; NULL is neither equal nor different."""
    return df.filter(named(column) != F.lit(expected))


def column_set_diff(
    required: DataFrame, optional: DataFrame, actual: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(keys, change): required but missing, unexpected, and present optional columns."""
    cols = [named(k) for k in keys]
    required, optional, actual = (d.select(*cols) for d in (required, optional, actual))
    known = required.unionAll(optional)
    parts = {
        "missing": required.subtract(actual),
        "extra": actual.subtract(known),
        "present_optional": optional.intersect(actual),
    }
    return reduce(
        DataFrame.unionAll, [d.withColumn("change", F.lit(label)) for label, d in parts.items()]
    )
