"""Row, column and dataset checksums.

The digest of a set of rows is the sum of the row hashes, piece by piece: it does
not depend on the order, counts copies, combines on the map side and ends in
one row, whatever the size of the table. It is not the digest over the sorted
list of hashes that other tools keep: that needs all hashes in one place, so
stored digests of that kind cannot be compared with these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.results import (
    Check, error_list, error_row, result_rows, result_struct, run_checks,
)
from tidewatch.functions.scalars import quoted

#: Hex digits of a hash by algorithm; a sum takes four of them, so it stays within BIGINT for 2^47 rows.
DIGITS = {"md5": 32, "sha256": 64}
PIECE = 4


def digest(text: Column, algorithm: str = "md5") -> Column:
    return F.sha2(text, 256) if algorithm == "sha256" else F.md5(text)


def value_text(column: str) -> str:
    """SQL text of a value in its text form."""
    return f"coalesce(CAST({quoted(column)} AS STRING), 'NULL')"


def row_checksum(columns: Sequence[str], algorithm: str = "md5") -> Column:
    """Hash of ``a|b|...`` with NULL written as ``NULL``."""
    text = F.expr(f"concat_ws('|', {', '.join(value_text(c) for c in columns)})")
    return digest(text, algorithm)


def duplicate_groups(
    df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "md5"
) -> DataFrame:
    """Number of distinct row hashes that occur more than once (groups, not extra rows)."""
    hashes = df.select(row_checksum(columns or df.columns, algorithm).alias("h"))
    return (
        hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("duplicate_count"))
    )


def _pieces(algorithm: str) -> int:
    return DIGITS["sha256" if algorithm == "sha256" else "md5"] // PIECE


def _piece_sums(hash_hex: Column, prefix: str, algorithm: str, copies: Column | None = None) -> list[Column]:
    """Sums of all 16-bit pieces of a hash, cut from numbers of twelve hex digits."""
    numbers = [F.conv(F.substring(hash_hex, start, 12), 16, 10).cast("bigint") for start in range(1, _pieces(algorithm) * PIECE, 12)]
    sums = []
    for i in range(_pieces(algorithm)):
        number, at = divmod(i, 3)
        width = min(3, _pieces(algorithm) - 3 * number)  # pieces in this number
        piece = F.shiftright(numbers[number], 16 * (width - 1 - at)).bitwiseAND(F.lit(0xFFFF))
        sums.append(F.sum(piece if copies is None else piece * copies).alias(f"{prefix}{i}"))
    return sums


def _combined(prefix: str, count: Column, algorithm: str) -> Column:
    sums = [F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).cast("string") for i in range(_pieces(algorithm))]
    return digest(F.concat_ws("|", count.cast("string"), *sums), algorithm)


def dataset_checksum(
    df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "md5"
) -> DataFrame:
    """One digest for the whole table, independent of row order, from one scan."""
    hashes = df.select(row_checksum(columns or df.columns, algorithm).alias("h"))
    return hashes.agg(F.count(F.lit(1)).alias("n"), *_piece_sums(F.col("h"), "w", algorithm)).select(
        F.col("n").alias("total_records"),
        _combined("w", F.col("n"), algorithm).alias("dataset_checksum"),
    )


def column_checksums(
    df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "md5"
) -> DataFrame:
    """The same digest for every column on its own; all columns in one scan."""
    columns = list(columns or df.columns)
    sums = [s for i, c in enumerate(columns) for s in _piece_sums(row_checksum([c], algorithm), f"c{i}_", algorithm)]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                _combined(f"c{i}_", F.col("n"), algorithm).alias("column_checksum"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("n"), *sums).select(F.inline(rows))


def checksum_check(
    df: DataFrame,
    expected_checksum: str | None = None,
    columns: Sequence[str] | None = None,
    detect_duplicates: bool = False,
    algorithm: str = "md5",
    name: str = "ChecksumValidator",
) -> DataFrame:
    """Compare the dataset digest and, on request, look for duplicate rows.

    Unknown columns are reported and skipped; with none left the check is an error.
    """
    wanted = list(columns or df.columns)
    present = [c for c in wanted if c in df.columns]
    missing = [c for c in wanted if c not in df.columns]
    if not present:
        return error_row(
            df.sparkSession, name, "No valid columns for checksum calculation",
            [f"Checksum columns not found: {', '.join(missing)}"],
        )
    if not detect_duplicates:
        plan = checksum_plan(df, expected_checksum, columns, algorithm, name)
        return run_checks(df, [plan]).drop("position")
    # One row per distinct hash first: copies meet on the map side.
    per_hash = (
        df.select(row_checksum(present, algorithm).alias("h"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    )
    measured = per_hash.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        F.count_if(F.col("copies") > 1).alias("duplicates"),
        *_piece_sums(F.col("h"), "w", algorithm, F.col("copies")),
    )
    measured = measured.withColumn("_dataset_checksum", _combined("w", F.col("total"), algorithm))
    return result_rows(
        measured,
        checksum_verdict(present, missing, expected_checksum, algorithm, name, F.col("duplicates")),
    )


def checksum_plan(
    df: DataFrame,
    expected_checksum: str | None = None,
    columns: Sequence[str] | None = None,
    algorithm: str = "md5",
    name: str = "ChecksumValidator",
) -> Check:
    """The checksum comparison as a part of ``run_checks`` (without a search for duplicates)."""
    wanted = list(columns or df.columns)
    present = [c for c in wanted if c in df.columns]
    if not present:
        raise ValueError("No valid columns for checksum calculation")
    missing = [c for c in wanted if c not in df.columns]
    return Check(
        measures=_piece_sums(row_checksum(present, algorithm), "w", algorithm),
        steps=[{"_dataset_checksum": _combined("w", F.col("total"), algorithm)}],
        verdict=checksum_verdict(present, missing, expected_checksum, algorithm, name),
    )


def checksum_verdict(
    present: Sequence[str],
    missing: Sequence[str] = (),
    expected_checksum: str | None = None,
    algorithm: str = "md5",
    name: str = "ChecksumValidator",
    duplicates: Column | None = None,
) -> Column:
    """Result struct over ``total`` and ``_dataset_checksum``."""
    total, actual = F.col("total"), F.col("_dataset_checksum")
    found = F.lit(0) if duplicates is None else duplicates
    errors = [F.lit(f"Checksum columns not found: {', '.join(missing)}")] if missing else []
    copies = F.concat(
        F.lit("Found "), found.cast("string"), F.lit(" duplicate row(s) based on checksum")
    )
    errors.append(F.when(found > 0, copies))
    if expected_checksum:
        differs = F.concat(
            F.lit(f"Dataset checksum mismatch: expected '{expected_checksum}', got '"), actual, F.lit("'")
        )
        errors.append(F.when(actual != expected_checksum, differs))
    listed = error_list(*errors)
    no_rows, clean = total == 0, F.size(listed) == 0
    message = (
        F.when(no_rows, "Cannot validate checksums: DataFrame is empty")
        .when(clean, f"Checksum validation passed (algorithm: {algorithm})")
        .otherwise(
            F.concat(
                F.lit("Checksum validation failed: "), F.size(listed).cast("string"),
                F.lit(" issue(s) found"),
            )
        )
    )
    details = F.to_json(
        F.struct(
            actual.alias("dataset_checksum"),
            F.lit(algorithm).alias("checksum_algorithm"),
            F.lit(",".join(present)).alias("checksum_columns"),
        )
    )
    return result_struct(
        name,
        F.when(no_rows, "warning").when(clean, "passed").otherwise("failed"),
        total,
        F.when(no_rows, 0).otherwise(found),
        message,
        F.when(no_rows, error_list()).otherwise(listed),
        details,
    )
