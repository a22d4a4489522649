"""Data-quality validators: every check of a table is fused into one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from tidewatch.functions import fixed
from tidewatch.functions.results import Check, error_list, result_rows, result_struct, run_checks
from tidewatch.functions.scalars import (
    lookup, named, quoted, round_exact, safe_rate, sql_array, text_array,
)


def type_family(data_type: DataType) -> str:
    """Type name without precision: ``decimal(10,2)`` becomes ``decimal``."""
    return data_type.simpleString().split("(")[0]


def _percent(part: Column, whole: Column) -> Column:
    return round_exact(safe_rate(part, whole))


# --- nulls -----------------------------------------------------------------


def _null_cells(columns: Sequence[str]) -> Column:
    """Aggregation: the number of NULLs per column, as one array."""
    if not columns:
        return F.array().cast("array<bigint>")
    return sql_array(f"count_if({quoted(c)} IS NULL)" for c in columns)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column from a single scan: (column_name, total, nulls, percent)."""
    columns = [c for c in (columns or df.columns) if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("total_records"), _null_cells(columns).alias("_nulls"))
    return counts.select("total_records", F.posexplode("_nulls").alias("_i", "null_count")).select(
        F.element_at(text_array(columns), F.col("_i") + 1).alias("column_name"),
        "total_records",
        "null_count",
        _percent(F.col("null_count"), F.col("total_records")).alias("null_percentage"),
    )


def null_totals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL cells over all checked columns and their share of all cells."""
    per_column = null_counts(df, columns)
    return per_column.agg(
        F.sum("null_count").alias("total_null_values"),
        F.sum("total_records").alias("total_cells"),
    ).withColumn(
        "overall_null_percentage", _percent(F.col("total_null_values"), F.col("total_cells"))
    )


def null_plan(
    df: DataFrame,
    non_null_columns: Sequence[str] = (),
    max_null_percentage: float = 0.0,
    column_thresholds: Mapping[str, float] | None = None,
    columns: Sequence[str] | None = None,
    name: str = "NullValidator",
) -> Check:
    """The null check as a part of :func:`run_checks`."""
    wanted = list(columns or df.columns)
    present = [c for c in wanted if c in df.columns]
    total, cells, overall, empty, found = (
        F.col(c) for c in ("total", "_null_cells", "_null_share", "_empty_columns", "_null_errors")
    )
    # One entry (name, nulls, share) per column, in the order of the table.
    entries = F.transform(
        F.arrays_zip(text_array(present), F.col("_nulls")),
        lambda e: F.struct(
            e["0"].alias("name"), e["_nulls"].alias("nulls"), _percent(e["_nulls"], total).alias("share")
        ),
    )

    def over(what: str, limit: Callable[[Column], Column], chosen: Column) -> Column:
        """Errors of the chosen entries whose share exceeds the limit of their column."""
        return F.transform(
            F.filter(chosen, lambda e: e["share"] > limit(e["name"])),
            lambda e: F.concat(
                F.lit("Column '"), e["name"], F.lit(f"' exceeds {what}: "), e["share"].cast("string"),
                F.lit("% > "), limit(e["name"]).cast("string"), F.lit("%"),
            ),
        )

    def ordered(names: Iterable[str]) -> Column:
        """The entries of the given columns, in the given order."""
        return F.flatten(
            F.transform(
                text_array([n for n in names if n in present]),
                lambda n: F.filter("_null_entries", lambda e: e["name"] == n),
            )
        )

    parts = [text_array(f"Column '{c}' not found in DataFrame" for c in wanted if c not in present)]
    if non_null_columns:
        parts.append(
            F.transform(
                F.filter(ordered(non_null_columns), lambda e: e["nulls"] > 0),
                lambda e: F.concat(
                    F.lit("Column '"), e["name"], F.lit("' must not contain nulls, found "),
                    e["nulls"].cast("string"), F.lit(" ("), e["share"].cast("string"), F.lit("%)"),
                ),
            )
        )
    if column_thresholds:
        limits = {c: float(x) for c, x in column_thresholds.items()}
        no_limit = F.lit(None).cast("double")
        parts.append(over("null threshold", lambda name: lookup(name, limits, no_limit), ordered(limits)))
    if max_null_percentage > 0:
        limit = F.lit(float(max_null_percentage))
        parts.append(over("global null threshold", lambda _: limit, F.col("_null_entries")))
    empty_text = F.concat(
        F.lit("Found "), F.size(empty).cast("string"),
        F.lit(" completely empty column(s): "), F.array_join(empty, ", "),
    )
    parts.append(error_list(F.when(F.size(empty) > 0, empty_text)))
    no_rows, clean = total == 0, F.size(found) == 0
    passed_text = F.concat(
        F.lit("Null validation passed: "), overall.cast("string"), F.lit("% null values overall")
    )
    failed_text = F.concat(
        F.lit("Null validation failed: "), F.size(found).cast("string"), F.lit(" issue(s) found")
    )
    details = F.to_json(
        F.struct(
            F.lit(len(wanted)).alias("columns_checked"),
            F.map_from_entries(
                F.transform("_null_entries", lambda e: F.struct(e["name"], e["nulls"]))
            ).alias("null_counts"),
            empty.alias("empty_columns"), cells.alias("total_null_values"),
            overall.alias("overall_null_percentage"),
        )
    )
    empty_columns = F.transform(
        F.filter("_null_entries", lambda e: e["nulls"] == total), lambda e: e["name"]
    )
    return Check(
        measures=[_null_cells(present).alias("_nulls")],
        steps=[
            {
                "_null_entries": entries,
                "_null_cells": F.aggregate("_nulls", F.lit(0).cast("bigint"), lambda a, n: a + n),
            },
            {"_empty_columns": empty_columns, "_null_share": _percent(cells, total * len(wanted))},
            {"_null_errors": F.concat(*parts)},
        ],
        verdict=result_struct(
            name,
            F.when(no_rows, "warning").when(clean, "passed").otherwise("failed"),
            total,
            F.when(no_rows, 0).otherwise(cells),
            F.when(no_rows, "Cannot validate nulls: DataFrame is empty")
            .when(clean, passed_text).otherwise(failed_text),
            F.when(no_rows, error_list()).otherwise(found),
            details,
        ),
    )


def null_check(df: DataFrame, *args, **kwargs) -> DataFrame:
    """Fails on NULLs in mandatory columns, exceeded shares and empty columns.

    Arguments as in :func:`null_plan`. ``failed_records`` counts NULL cells, so
    a pass rate may be negative.
    """
    return run_checks(df, [null_plan(df, *args, **kwargs)]).drop("position")


# --- types, patterns and ranges ---------------------------------------------


def type_mismatch(df: DataFrame, column: str, declared: str) -> Column:
    """True for values that do not fit the declared type; constant False if the type agrees."""
    declared = declared.lower()
    actual = type_family(df.schema[column].dataType)
    value = named(column)
    if actual in fixed.TYPE_FAMILIES.get(declared, ()):
        return F.lit(False)
    if declared == "boolean":
        text = value.cast("string")
        return value.isNotNull() & ~text.isin(*fixed.BOOLEAN_TEXTS)
    target = {"integer": "bigint", "float": "double", "date": "date"}.get(declared)
    if target is None:
        return F.lit(False)
    if actual in ("string", "boolean") or (actual in ("date", "timestamp", "timestamp_ntz")):
        # Values without a numeric or date reading become NULL instead of failing the job.
        return value.isNotNull() & value.cast("string").try_cast(target).isNull()
    if target == "date":
        return value.isNotNull() & value.cast("string").try_cast("date").isNull()
    return value.isNotNull() & value.try_cast(target).isNull()


def type_matches(df: DataFrame, column: str, declared: str) -> bool:
    actual = type_family(df.schema[column].dataType)
    return actual in fixed.TYPE_FAMILIES.get(declared.lower(), ())


def pattern_mismatch(column: str, pattern: str) -> Column:
    """Non-NULL values in which the pattern is not found."""
    return named(column).isNotNull() & ~named(column).cast("string").rlike(pattern)


def as_number(df: DataFrame, column: str) -> Column:
    """The column as is when numeric, else read as a number where possible."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}
    if type_family(df.schema[column].dataType) in numeric:
        return named(column)
    return named(column).cast("string").try_cast("double")


def out_of_range(df: DataFrame, column: str, low: float | None, high: float | None) -> Column:
    value = as_number(df, column)
    too_low = value < low if low is not None else F.lit(False)
    too_high = value > high if high is not None else F.lit(False)
    return value.isNotNull() & (too_low | too_high)


def datatype_columns(
    df: DataFrame,
    column_types: Mapping[str, str] | None = None,
    string_patterns: Mapping[str, str] | None = None,
    numeric_ranges: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """One row per checked column with all its counts, from one scan of the table."""
    types = {c: t for c, t in (column_types or {}).items() if c in df.columns}
    patterns = {c: p for c, p in (string_patterns or {}).items() if c in df.columns}
    ranges = {c: r for c, r in (numeric_ranges or {}).items() if c in df.columns}
    checked = list(dict.fromkeys([*types, *patterns, *ranges]))
    no_count = F.lit(None).cast("bigint")
    no_value = F.lit(None).cast("double")
    aggregates: list[Column] = [F.count(F.lit(1)).alias("total_records")]
    rows = []
    for i, c in enumerate(checked):
        fields = [
            F.lit(c).alias("column_name"),
            F.lit(types.get(c)).cast("string").alias("expected_type"),
            F.lit(df.schema[c].dataType.simpleString()).alias("actual_type"),
            F.lit(type_matches(df, c, types[c]) if c in types else None).cast("boolean").alias("type_matches"),
        ]
        if c in types:
            aggregates.append(F.count_if(type_mismatch(df, c, types[c])).alias(f"_t{i}"))
        if c in patterns:
            aggregates.append(F.count_if(pattern_mismatch(c, patterns[c])).alias(f"_p{i}"))
        if c in ranges:
            number = as_number(df, c).cast("double")
            aggregates += [
                F.count_if(out_of_range(df, c, *ranges[c])).alias(f"_r{i}"),
                F.min(number).alias(f"_lo{i}"),
                F.max(number).alias(f"_hi{i}"),
            ]
        fields += [
            (F.col(f"_t{i}") if c in types else no_count).alias("type_mismatch_count"),
            (F.col(f"_p{i}") if c in patterns else no_count).alias("pattern_mismatch_count"),
            (F.col(f"_r{i}") if c in ranges else no_count).alias("out_of_range_count"),
            (F.col(f"_lo{i}") if c in ranges else no_value).alias("actual_min"),
            (F.col(f"_hi{i}") if c in ranges else no_value).alias("actual_max"),
        ]
        rows.append(F.struct(*fields))
    if not rows:
        raise ValueError("no column of the table is checked")
    return df.agg(*aggregates).select("total_records", F.inline(F.array(*rows)))


def cell_failures(
    df: DataFrame,
    column_types: Mapping[str, str] | None = None,
    string_patterns: Mapping[str, str] | None = None,
    numeric_ranges: Mapping[str, tuple] | None = None,
) -> Column:
    """Aggregation that counts failing cells over all type, pattern and range checks."""
    checks = [type_mismatch(df, c, t) for c, t in (column_types or {}).items() if c in df.columns]
    checks += [pattern_mismatch(c, p) for c, p in (string_patterns or {}).items() if c in df.columns]
    checks += [out_of_range(df, c, *r) for c, r in (numeric_ranges or {}).items() if c in df.columns]
    return sum((F.count_if(check) for check in checks), F.lit(0).cast("bigint"))


def datatype_plan(
    df: DataFrame,
    column_types: Mapping[str, str] | None = None,
    string_patterns: Mapping[str, str] | None = None,
    numeric_ranges: Mapping[str, tuple] | None = None,
    name: str = "DatatypeValidator",
) -> Check:
    """The datatype check as a part of :func:`run_checks`."""
    failures = cell_failures(df, column_types, string_patterns, numeric_ranges)
    missing = [c for c in (column_types or {}) if c not in df.columns]
    return Check(
        measures=[failures.alias("_type_failures")],
        steps=[],
        verdict=datatype_verdict(F.col("total"), F.col("_type_failures"), name, missing),
    )


def datatype_check(df: DataFrame, *args, **kwargs) -> DataFrame:
    """Result row over all type, pattern and range checks (95 % or better is a warning)."""
    return run_checks(df, [datatype_plan(df, *args, **kwargs)]).drop("position")


def datatype_verdict(
    total: Column, failed: Column, name: str | Column, missing: Sequence[str] = ()
) -> Column:
    """Status bands of the datatype validator for already counted failures."""
    rate = safe_rate(total - failed, total, 100.0)
    status = F.when(failed == 0, "passed").when(rate >= 95, "warning").otherwise("failed")
    message = F.when(failed == 0, "All datatype validations passed").otherwise(
        F.concat(failed.cast("string"), F.lit(" records failed datatype validation"))
    )
    errors = error_list(*[F.lit(f"Column '{c}' not found in DataFrame") for c in missing])
    return result_struct(name, status, total, failed, message, errors, rate=rate)


def datatype_status(df: DataFrame, total: Column, failed: Column, name: str | Column) -> DataFrame:
    return result_rows(df, datatype_verdict(total, failed, name))


# --- columns and schema ------------------------------------------------------


def schema_table(df: DataFrame, dataset_name: str) -> DataFrame:
    """Columns of a table as rows: (dataset_name, column_name, data_type, nullable, position)."""
    rows = [
        (dataset_name, f.name, f.dataType.simpleString(), f.nullable, i)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "dataset_name string, column_name string, data_type string, nullable boolean, position int"
    )


def row_count(df: DataFrame, dataset_name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records")).withColumn("dataset_name", F.lit(dataset_name))


def column_existence(
    expected: DataFrame,
    observed: DataFrame,
    row_counts: DataFrame,
    allow_extra_columns: bool = True,
    case_sensitive: bool = True,
    name: str = "ColumnExistenceValidator",
) -> DataFrame:
    """Required, optional and extra columns for all datasets at once.

    ``expected``: (dataset_name, column_name, required); ``observed``:
    (dataset_name, column_name); ``row_counts``: (dataset_name, total_records).
    Without any expectation no column counts as extra.
    """
    def fold(df: DataFrame) -> DataFrame:
        if case_sensitive:
            return df
        return df.withColumn("column_name", F.lower("column_name"))

    want = fold(expected).groupBy("dataset_name", "column_name").agg(
        F.bool_or("required").alias("required")
    )
    have = fold(observed).select("dataset_name", "column_name").distinct().withColumn("_seen", F.lit(True))
    seen = F.col("_seen").isNotNull()
    known = F.col("required").isNotNull()

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("column_name"))))

    compared = (
        want.join(have, ["dataset_name", "column_name"], "full_outer")
        .groupBy("dataset_name")
        .agg(
            F.count_if(F.col("required")).alias("required_count"),
            F.count_if(known).alias("expected_count"),
            names(F.col("required") & ~seen).alias("missing_columns"),
            names(seen & ~known).alias("extra_columns"),
            names(seen & known & ~F.col("required")).alias("present_optional_columns"),
        )
        .withColumn(
            "extra_columns",
            F.when(F.col("expected_count") > 0, F.col("extra_columns")).otherwise(error_list()),
        )
        .join(row_counts, "dataset_name", "left")
    )
    verdict = existence_verdict(
        F.col("required_count"), F.col("missing_columns"), F.col("extra_columns"),
        F.col("present_optional_columns"), F.coalesce("total_records", F.lit(0)),
        allow_extra_columns, name,
    )
    return compared.select("dataset_name", verdict.alias("r")).select("dataset_name", "r.*")


def _count_text(items: Column, text: str) -> Column:
    return F.concat(F.size(items).cast("string"), F.lit(text))


def existence_verdict(
    required_count: Column,
    missing: Column,
    extra: Column,
    optional: Column,
    rows: Column,
    allow_extra_columns: bool = True,
    name: str = "ColumnExistenceValidator",
) -> Column:
    """Result struct from the lists of missing, extra and present optional columns."""
    refused = F.lit(False) if allow_extra_columns else F.size(extra) > 0
    status = F.when(F.size(missing) > 0, "failed").when(refused, "warning").otherwise("passed")
    some_optional = F.concat(F.lit(", "), _count_text(optional, " optional column(s) present"))
    some_extra = F.concat(F.lit(", "), _count_text(extra, " extra column(s) allowed"))
    message = (
        F.when(
            status == "failed",
            F.concat(F.lit("Column validation failed: "), _count_text(missing, " required column(s) missing")),
        )
        .when(
            status == "warning",
            F.concat(F.lit("Column validation warning: "), _count_text(extra, " unexpected column(s) found")),
        )
        .otherwise(
            F.concat(
                F.lit("All "), required_count.cast("string"), F.lit(" required columns present"),
                F.when(F.size(optional) > 0, some_optional).otherwise(""),
                F.when(F.size(extra) > 0, some_extra).otherwise(""),
            )
        )
    )
    errors = error_list(
        F.when(
            F.size(missing) > 0,
            F.concat(F.lit("Missing "), _count_text(missing, " required column(s): "), F.array_join(missing, ", ")),
        ),
        F.when(
            refused,
            F.concat(F.lit("Found "), _count_text(extra, " unexpected column(s): "), F.array_join(extra, ", ")),
        ),
    )
    details = F.to_json(
        F.struct(
            missing.alias("missing_columns"), extra.alias("extra_columns"),
            optional.alias("present_optional_columns"),
        )
    )
    passed = status == "passed"
    return result_struct(
        name, status, F.when(passed, rows).otherwise(0), F.lit(0), message, errors, details,
        F.when(passed, 100.0).otherwise(0.0),
    )


def schema_check(
    expected: DataFrame,
    observed: DataFrame,
    row_counts: DataFrame,
    name: str = "SchemaValidator",
) -> DataFrame:
    """Required columns and exact type names for all datasets at once.

    ``expected``: (dataset_name, column_name, required, data_type), where a
    NULL type is not compared; extra columns are only listed.
    """
    want = expected.select(
        "dataset_name", "column_name", "required", F.col("data_type").alias("expected_type")
    )
    have = observed.select(
        "dataset_name", "column_name", F.col("data_type").alias("actual_type"),
        F.lit(True).alias("_seen"),
    )
    seen = F.col("_seen").isNotNull()
    known = F.col("required").isNotNull()
    wrong = seen & known & (F.col("expected_type") != F.col("actual_type"))
    mismatch = F.concat_ws(
        " ", F.col("column_name"), F.lit("expected"), F.col("expected_type"),
        F.lit("actual"), F.col("actual_type"),
    )

    def listed(condition: Column, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, value)))

    compared = (
        want.join(have, ["dataset_name", "column_name"], "full_outer")
        .groupBy("dataset_name")
        .agg(
            listed(F.col("required") & ~seen, F.col("column_name")).alias("missing_columns"),
            listed(wrong, mismatch).alias("type_mismatches"),
            listed(seen & ~known, F.col("column_name")).alias("extra_columns"),
            F.count_if(seen).alias("column_count"),
        )
        .join(row_counts, "dataset_name", "left")
    )
    verdict = schema_verdict(
        F.col("missing_columns"), F.col("type_mismatches"), F.col("extra_columns"),
        F.col("column_count"), F.coalesce("total_records", F.lit(0)), name,
    )
    return compared.select("dataset_name", verdict.alias("r")).select("dataset_name", "r.*")


def schema_verdict(
    missing: Column, wrong: Column, extra: Column, column_count: Column, rows: Column,
    name: str = "SchemaValidator",
) -> Column:
    """Result struct from the lists of missing columns and wrong types."""
    errors = error_list(
        F.when(
            F.size(missing) > 0, F.concat(F.lit("Missing required columns: "), F.array_join(missing, ", "))
        ),
        F.when(
            F.size(wrong) > 0,
            F.concat(F.lit("Type mismatches found in "), _count_text(wrong, " column(s)")),
        ),
    )
    passed = F.size(errors) == 0
    message = F.when(passed, "Schema validation passed").otherwise(
        F.concat(F.lit("Schema validation failed: "), _count_text(errors, " issue(s) found"))
    )
    total = F.when(passed, rows).otherwise(0)
    details = F.to_json(
        F.struct(
            missing.alias("missing_columns"), wrong.alias("type_mismatches"),
            extra.alias("extra_columns"), column_count.alias("column_count"),
        )
    )
    return result_struct(
        name, F.when(passed, "passed").otherwise("failed"), total, F.lit(0), message, errors, details
    )
